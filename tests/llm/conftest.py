import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Made-up text that repeats no five words in a row by chance."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 97))
    return " ".join(out)


@pytest.fixture
def documents(spark):
    def make(rows, extra=""):
        """Rows (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s0")), len(r[1] or ""), *r[4:]) for r in rows]
        return spark.createDataFrame(full, SCHEMA + extra)

    return make


@pytest.fixture
def odd_documents(documents):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = prose(5, 30_000)
    rows = [
        (1, prose(1, 80), "en", "s0"),
        (2, None, None, None),
        (3, "", "de", "s1"),
        (4, long, "en", "s0"),
        (5, prose(1, 80), "en", "s1"),
        (5, prose(1, 80), "en", "s1"),
        (None, prose(2, 60), "fr", None),
        (7, " \t\n ", "en", "s2"),
        (8, "a b   é́ <|endoftext|> \U0001f600", "xx", "s2"),
    ]
    clash = ", size long, copies int, spans string, kept boolean, node long, chance double, block string"
    return documents([(*r, 7, 9, "x", False, 3, 0.5, "b") for r in rows], clash)
