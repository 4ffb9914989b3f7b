import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, row bigint, "
          "`key` string, shard int, label int, score double, _row string, _pick bigint, mark bigint, spans string, `ids` string")
CLASH = ("f", 1, "k", 2, 3, 0.5, "r", 4, 5, "s", "i")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, source]) rows, with further columns under names that the operators use themselves."""
    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "web", None, *CLASH) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


LONG = " ".join(f"word{n % 977} and{n % 13}." for n in range(40_000))
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank on a sunny day."),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank on a sunny day."),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank on a sunny day."),
    (3, None), (4, ""), (5, " \n\t \n"), (6, LONG, None), (None, "a text without an id"), (None, None, None),
    (7, "x"), (8, "é" * 300), (9, "line\nline\nline\n\nline"), (-10, "\x00\x0b mixed   blanks   here"),
]


@pytest.fixture(scope="session")
def edge(documents):
    return documents(EDGE_ROWS)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
