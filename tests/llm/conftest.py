import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(n: int, seed: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % 26] + str((x >> 16) % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names, hot copies."""
    long = prose(20_000, 1)
    shared = prose(70, 2)
    rows = [
        (1, prose(120, 3), "a"), (2, prose(120, 3), "a"), (2, prose(120, 3), "a"), (3, "", "b"), (4, None, "b"), (None, prose(80, 3), None), (5, long, None),
        (6, prose(30, 4) + " " + shared + " " + prose(10, 5), "b"), (7, prose(9, 6) + " " + shared, "a"), (8, shared.upper(), "c"), (9, "  \t x \n\nline number one here\nLINE NUMBER ONE HERE \nshort\n", "c"),
        (10, "line number one here\r\nélan vital ÉTÉ\nshort", "c"), (2, "another text under the same id\nline number one here", "a"), (11, long[:5000] + " tail", "a"), (12, "   ", "b"),
    ] + [(100 + k, prose(60, 9), "hot") for k in range(40)]
    return spark.createDataFrame([(i, t, s, k, "fp", None, 1) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, shard int, digest string, row long, n int")


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
