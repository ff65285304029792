import pytest

LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(30_000))
LINE = "a line that many of the documents share"
ROWS = [
    (1, "One two three four five six seven.\n" + LINE, "en", "a"),
    (2, "One two three four five six seven.\n" + LINE, "en", "a"),
    (2, "One two three four five six seven.\n" + LINE, "en", "a"),
    (3, LINE.upper() + "\n" + LINE, None, None),
    (4, None, "en", None),
    (5, "", "fr", "b"),
    (6, " \t\n ", None, "b"),
    (7, LONG, "en", "c"),
    (8, "été　中文 <|endoftext|> 😀 Ünïcode", "fr", "c"),
    (9, "12 34 !!", "fr", "c"),
    (None, "a document without an id", "en", None),
    (None, None, None, None),
]
# names that the operators use themselves
EXTRA = "fingerprint component_id n_lines n_dropped sequence_id offset piece row lot shard error kind u v node".split()


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    rows = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * len(EXTRA)) for r in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
