"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is a vector of its tag path (hashed tags, classes and ids), its
hashed words and a few counts. A bidirectional LSTM in numpy reads the whole sequence and says of each block whether it
is article text, so a block is judged by the document around it.

No table labels blocks, so the labeller is fitted on a bounded sample of pages that say where their article is
(``article`` or ``main``), as they are, with these marks taken off, and re-dressed in drawn layouts where class names and order vary and the article
sits in a plain container. Extraction then reads every page whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import hash_sample, table
from locusframe.llm.decontamination import shards_of

#: Fixed values of HTML: elements whose text is not text, that end a line but no block, that have no end tag.
RAW = ("script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "select", "title", "canvas")
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mpadded mphantom menclose semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_KIND = {"li": "li", "tr": "tr", "td": "td", "th": "td", "dt": "dd", "dd": "dd", "option": "option"}
#: Elements nested deeper than this are read as siblings, as browsers do, so a block's path has a bounded length; their end
#: tags close nothing.
MAX_DEPTH = 512
#: Quantifiers are possessive and a tag with an open quote ends at its next ">", so no scan starts over.
_TOKEN = re.compile(
    r"<!--.*?(-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*+>.*?(?P<end></(?P=raw)\s*>|\Z)"
    r"|<(?P<back>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?:(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|[^>]*+>)|<[!?][^>]*+>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"\s+")

Block = tuple[tuple[str, ...], str, int]  # path, text, characters inside links


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: text between starts and ends of block elements, decoded, blanks made one space.

    Work is in proportion to the page: tokens are found in one pass, and open elements are at most MAX_DEPTH.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, names, whether inside a link
    path: tuple[str, ...] | None = ()
    held: list[str] = []
    linked = 0
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # blocks with one path share it
    skipped: Counter[str] = Counter()  # start tags beyond MAX_DEPTH that are still open

    def close() -> None:
        nonlocal linked, path
        text = _BLANK.sub(" ", "".join(held)).strip()
        if text:
            if path is None:
                path = tuple(n for tag, names, _ in stack if tag not in INLINE for n in names)
                path = paths.setdefault(path, path)
            out.append((path, text, linked))
        held.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            held.append(piece)
            linked += len(piece) if stack and stack[-1][2] else 0

    def cut(depth: int | None) -> None:
        nonlocal path
        if depth is not None:
            del stack[depth:]
            path = None

    at, last = 0, page.rfind(">") + 1  # after the last ">" there is no tag
    for m in _TOKEN.finditer(page, 0, last):
        add(page[at : m.start()])
        at = m.end()
        if m[1] == "" or m["end"] == "":  # a comment or a raw element that nothing ends takes the rest
            at = len(page)
            break
        if not m["tag"]:
            continue
        tag, rest = m["tag"].lower(), m["rest"]
        rest = m[0] if rest is None else rest
        if m["back"]:
            if tag not in INLINE:
                close()
            if skipped[tag]:
                skipped[tag] -= 1
            else:
                cut(next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None))
        else:
            if tag not in INLINE:
                close()
                if tag in CLOSES_P:
                    depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), None)
                    if depth is not None and stack[depth][0] == "p":
                        cut(depth)
                elif tag in OWN_KIND:
                    depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), None)
                    if depth is not None and OWN_KIND.get(stack[depth][0]) == OWN_KIND[tag]:
                        cut(depth)
            elif tag in ("br", "wbr"):
                held.append(" " if tag == "br" else "")
            opens = tag not in VOID and not rest.rstrip().endswith("/")
            if opens and len(stack) >= MAX_DEPTH:
                skipped[tag] += 1
            elif opens:
                names = [tag, *(f".{w}" for g in _NAMES.findall(rest) for w in re.split(r"[^a-z0-9]+", "".join(g).lower()) if w)] if rest else [tag]
                stack.append((tag, tuple(names), tag == "a" or bool(stack) and stack[-1][2]))
                path = None
    rest = page[at:]
    add(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    close()
    return out


PATH_DIMS, WORD_DIMS, COUNT_DIMS, HIDDEN = 192, 48, 8, 24
#: Blocks of all pages of a group that are labelled in one stretch.
STRETCH = 20_000
DIMS = PATH_DIMS + WORD_DIMS + COUNT_DIMS
_paths: dict[tuple[str, ...], np.ndarray] = {}
_words: dict[str, int] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if (found := _paths.get(path)) is None:
        found = np.zeros(PATH_DIMS, np.float32)
        for name in path:
            found[crc32(name.encode()) % PATH_DIMS] = 1
        for name in path[-2:]:
            found[crc32(("leaf " + name).encode()) % PATH_DIMS] = 1
        if len(_paths) > 50_000:
            _paths.clear()
        _paths[path] = found
    return found


def vectors_of(blocks: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """The vectors of a page's blocks, or of blocks ``first`` to ``last``: path, words, counts and the place in the page."""
    some = blocks[first:last]
    out = np.zeros((len(some), DIMS), np.float32)
    if len(_words) > 300_000:
        _words.clear()
    for k, (path, text, linked) in enumerate(some):
        out[k, :PATH_DIMS] = _path_vector(path)
        words = text.split(" ")
        places = []
        for w in words:
            p = _words.get(w)
            if p is None:
                p = _words[w] = crc32(w.lower().encode("utf-8", "surrogatepass")) % (2 * WORD_DIMS)
            places.append(p)
        counts = np.bincount(places, minlength=2 * WORD_DIMS)
        signed = (counts[:WORD_DIMS] - counts[WORD_DIMS:]).astype(np.float32)
        out[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = signed / max(1.0, float(np.sqrt((signed * signed).sum())))
        n = len(text)
        out[k, -COUNT_DIMS:] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, linked / n, text[-1] in ".!?", sum(map(text.count, ".,;")) / len(words), text[:1].isupper(), (first + k) / len(blocks), 1 / len(blocks))
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output, forward and backward through time in numpy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": draw(DIMS, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
        self.p |= {"o": draw(2 * HIDDEN, 1), "ob": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = True) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """x: (steps, pages, DIMS). A masked step leaves the state at zero, so padding on either side does not matter. What
        the slopes need of each step is kept only if asked for."""
        steps, pages, _ = x.shape
        ahead = (x.reshape(-1, DIMS) @ self.p[f"x{d}"] + self.p[f"c{d}"]).reshape(steps, pages, -1)
        h, c = state or (np.zeros((pages, HIDDEN), np.float32),) * 2
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = ahead[t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            before = (h, c)
            c = m * (f * c + i * g)
            h = m * (o * np.tanh(c))
            out[t] = h
            if keep:
                kept.append((t, before, i, f, o, g, c, m))
        return out, kept, (h, c)

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        """(steps, pages): over 0 where a block is article text. Pages go in stretches of STRETCH blocks in all, each
        direction carrying its state from one to the next, so memory does not follow the length of a page."""
        steps, size = max(map(len, pages)), max(1, STRETCH // len(pages))
        out = np.full((steps, len(pages)), self.p["ob"][0], np.float32)
        stretches = [(a, min(a + size, steps)) for a in range(0, steps, size)]
        once: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, half in (("f", self.p["o"][:HIDDEN, 0]), ("b", self.p["o"][HIDDEN:, 0])):
            state = None
            for a, b in stretches if d == "f" else stretches[::-1]:
                x, mask = once.get(a) or padded([vectors_of(p, a, b) for p in pages], b - a)
                if len(stretches) == 1:
                    once[a] = x, mask
                h, _, state = self._run(x, mask, d, state, keep=False)
                out[a:b] += h @ half
        return out

    def _slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        z = (both @ self.p["o"] + self.p["ob"])[:, :, 0]
        error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum())[:, :, None]
        out = {"o": np.einsum("tph,tpo->ho", both, error), "ob": error.sum((0, 1))}
        d_both = error @ self.p["o"].T
        for d in "fb":
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            dz_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
            dw = np.zeros_like(self.p[f"h{d}"])
            part = d_both[:, :, :HIDDEN] if d == "f" else d_both[:, :, HIDDEN:]
            for t, (h0, c0), i, f, o, g, c, m in reversed(runs[d][1]):
                dh = (dh + part[t]) * m
                tc = np.tanh(c)
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                dw += h0.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            out |= {f"h{d}": dw, f"x{d}": x.reshape(-1, DIMS).T @ dz_all.reshape(-1, 4 * HIDDEN), f"c{d}": dz_all.sum((0, 1))}
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 14, rate: float = 0.01, seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(rounds):
            order = np.argsort([len(p) + rng.random() * 4 for p in pages])
            groups = [order[k : k + 32] for k in range(0, len(order), 32)]
            rng.shuffle(groups)
            for group in groups:
                x, mask = padded([pages[k] for k in group])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(group):
                    y[: len(labels[k]), j] = labels[k]
                t += 1
                for k, g in self._slopes(x, mask, y).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are article text. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and stop - start < 128 and (stop - start + 1) * len(pages[order[stop]]) <= STRETCH:
                stop += 1
            group = order[start:stop]
            score = self.scores([pages[k] for k in group])
            for j, k in enumerate(group):
                out[k] = score[: len(pages[k]), j] > 0
            start = stop
        return out


def padded(pages: list[np.ndarray], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pages side by side, (steps, pages, DIMS), and which steps are theirs."""
    steps = steps or max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


#: Layout words from which training layouts are drawn.
SHELLS = ("nav", "nav menu", "div menu", "div navbar", "header", "div header", "div masthead", "ul breadcrumb", "div topbar", "div breadcrumbs", "aside", "div sidebar", "aside widget", "div related",
          "div recommended", "div ad", "div ads", "div advert", "div sponsored", "div banner", "div promo", "div cookie notice", "div notice", "div alert", "div popup modal", "form", "form search", "form login",
          "div newsletter subscribe", "div share social", "section comments", "div comments", "div comment reply", "div disqus thread", "ol commentlist", "footer", "div footer", "div copyright", "footer site footer", "div legal")
MAINS = ("article", "main", "article post", "div content", "div article body", "div post entry", "div main", "section story", "div entry content", "main content", "div text")
INSIDE = frozenset("nav aside footer form".split())


def _element(spec: str, inside: str, rng: np.random.Generator) -> str:
    tag, *names = spec.split()
    attribute = f' {("class", "id")[int(rng.integers(2))] if len(names) == 1 else "class"}="{" ".join(names)}"' if names else ""
    return f"<{tag}{attribute}>{inside}</{tag}>"


def _redressed(main: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A drawn layout around the given article texts; which blocks are article is known by construction."""
    words = " ".join(main).split(" ")

    def shell(spec: str) -> str:
        few = lambda: html.escape("\x01" + " ".join(words[(s := int(rng.integers(len(words)))) : s + int(rng.integers(1, 14))]))
        tag = spec.split()[0]
        n = int(rng.integers(1, 6))
        if tag in ("nav", "ul", "ol") or "menu" in spec or "related" in spec or rng.random() < 0.25:
            rows = "".join(f'<li>{f"<a href=#>{few()}</a>" if rng.random() < 0.8 else few()}</li>' for _ in range(n))
            return _element(spec, rows if tag in ("ul", "ol") else f"<ul>{rows}</ul>", rng)
        if tag == "form":
            return _element(spec, "".join(f"<label>{few()}</label><input><button>{few()}</button>" for _ in range(n)), rng)
        return _element(spec, "".join(f"<p>{few()}</p>" for _ in range(n)) if rng.random() < 0.5 else few(), rng)

    pick = lambda n: "".join(shell(SHELLS[int(k)]) for k in rng.integers(0, len(SHELLS), n))
    tags = ["h1", *rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "pre", "td"], len(main)).tolist()]
    body = []
    for tag, text in zip(tags, main):
        wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}.get(tag, f"<{tag}>{{}}</{tag}>")
        body.append(wrap.format(html.escape(text)))
        if rng.random() < 0.04:
            body.append(pick(1))
    page = f"<html><body>{pick(int(rng.integers(0, 4)))}{_element(MAINS[int(rng.integers(len(MAINS)))], ''.join(body), rng)}{pick(int(rng.integers(0, 4)))}</body></html>"
    if rng.random() < 0.4:
        page = page.replace("<body>", "<body><div class=wrapper>").replace("</body>", "</div></body>")
    blocks = blocks_of(page)
    label = np.array(["\x01" not in b[1] for b in blocks], np.float32)
    return [(p, t.replace("\x01", "") or "-", n) for p, t, n in blocks], label


#: Names of the layout words that mark what is no article text even inside an article: adverts, comments, forms and so on.
NO_TEXT = INSIDE | {f".{w}" for spec in SHELLS for w in spec.split()[1:]}


def fit_labeller(pages: list[str], seed: int = 7) -> Labeller:
    """Fit on pages that mark their article, as they are and with the marks taken off, and on drawn layouts. Without any
    such page it is fitted on layouts alone."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    texts: list[list[str]] = []
    for page in pages:
        blocks = blocks_of(page)
        marked = np.array([bool({"article", "main"} & set(p)) and not NO_TEXT & set(p) for p, _, _ in blocks], np.float32)
        if marked.any():
            unmarked = [(tuple("div" if n in ("article", "main") else n for n in p), t, n) for p, t, n in blocks]
            xs += [vectors_of(blocks), vectors_of(unmarked)]
            ys += [marked, marked]
            texts.append([t for (p, t, n), m in zip(blocks, marked) if m])
    texts = texts or [["No page marks its article.", "So the layouts are drawn around this text."]]
    for k in range(max(len(xs) // 2, 300)):
        main = texts[k % len(texts)]
        blocks, label = _redressed(main[: int(rng.integers(1, len(main) + 1))], rng)
        if blocks:
            xs.append(vectors_of(blocks))
            ys.append(label)
    return Labeller(seed).fit(xs, ys)


def _extractor(labeller: Broadcast, html_col: str):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, html_col, 8 << 20):
                pages = [blocks_of(p or "") for p in part[html_col].to_pylist()]
                chosen = labeller.value.label(pages)
                texts = ["\n".join(b[1] for b, keep in zip(blocks, keeps) if keep) for blocks, keeps in zip(pages, chosen)]
                yield part.drop_columns([html_col]).append_column("__text", pa.array(texts, pa.string()))

    return extract


def fit_pages(pages: DataFrame, html_col: str = "html", train_pages: int = 500, train_chars: int = 20_000) -> Labeller:
    """Fit on at most ``train_pages`` whole pages of at most ``train_chars`` characters, drawn by hash."""
    some = pages.where(F.col(html_col).isNotNull() & (F.char_length(html_col) <= train_chars)).select(html_col)
    return fit_labeller([r[0] for r in hash_sample(some, train_pages, html_col).collect()])


def extract_text(pages: DataFrame, labeller: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` with ``__text`` for ``html``: article blocks, one a line. Null or empty html gives an empty text; rows
    may repeat; an empty table gives no rows; other columns pass through."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.drop(html_col).schema)
    return pages.mapInArrow(_extractor(pages.sparkSession.sparkContext.broadcast(labeller), html_col), f"{schema}, __text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_text(pages, fit_pages(pages))
    return found.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
