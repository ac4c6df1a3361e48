"""Main text and personal data on hard pages and texts: bounded memory, plain versions of labelling and of the fixed patterns."""

import resource

import numpy as np

from locusframe.llm import html_extract, pii


def plain_scores(model, blocks):
    """The labeller's score of each block, step by step on one page, from the weights alone."""
    x = html_extract.vectors_of(blocks).astype(np.float64)
    out = np.full(len(x), float(model.p["ob"][0]))
    n = html_extract.HIDDEN
    for d, half in (("f", model.p["o"][:n, 0]), ("b", model.p["o"][n:, 0])):
        h, c = np.zeros(n), np.zeros(n)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = x[t] @ model.p[f"x{d}"] + h @ model.p[f"h{d}"] + model.p[f"c{d}"]
            i, f, o = (1 / (1 + np.exp(-z[k * n : (k + 1) * n])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * n :])
            h = o * np.tanh(c)
            out[t] += h @ half
    return out


def test_labels_by_stretches_equal_a_plain_pass(monkeypatch):
    rng = np.random.default_rng(0)
    pages = [html_extract.blocks_of("<div>" + "".join(f"<p class=c{int(rng.integers(4))}>word {k} x{int(rng.integers(99))}. <a>l</a></p>" for k in range(n))) for n in (50, 120, 1, 7)]
    model = html_extract.Labeller(3)
    for stretch in (20_000, 60, 1):
        monkeypatch.setattr(html_extract, "STRETCH", stretch)
        got = model.scores(pages)
        for j, p in enumerate(pages):
            assert np.abs(got[: len(p), j] - plain_scores(model, p)).max() < 1e-5
        assert [x.tolist() for x in model.label([*pages, []])] == [(plain_scores(model, p) > 0).tolist() for p in [*pages, []]]


def test_a_page_of_many_blocks_takes_little_memory():
    model = html_extract.Labeller(3)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    blocks = html_extract.blocks_of("<p>x" * 100_000)
    assert len(blocks) == 100_000 and len(model.label([blocks])[0]) == 100_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000  # kB


def test_formulae_and_deep_nesting():
    assert html_extract.blocks_of("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.") == [(("p",), "Energy is E=m here.", 0)]
    n = html_extract.MAX_DEPTH
    page = "<article>" + "<div>" * (n + 90) + "deep" + "</div>" * 3 + "<p>in</p>" + "</div>" * (n + 87) + "out</article>after"
    assert [(p[:1], len(p), t) for p, t, _ in html_extract.blocks_of(page)] == [(("article",), n, "deep"), (("article",), n, "in"), (("article",), 1, "out"), ((), 0, "after")]


def test_dotted_numbers_with_many_zeros():
    zeros = "0" * 5000
    assert pii.base_spans(f"1.1.1.{zeros}1 x 10.0.0.256 y 1.2.3.4") == [("ip", 0, 5007), ("ip", 5023, 5030)]
    assert pii.base_spans(f"{zeros}.0.0.{'9' * 5000}") == []
