import pytest

SF = "/root/testdata/sf0.001"

#: Null, empty, wordless, very long, repeated and tied rows; extra columns whose names operators use inside.
EDGE = [
    (1, None, "en", "s"), (2, "", "en", "s"), (3, "  \n", "fr", "s"), (4, "one two three four five six seven", "en", "s"), (5, "one two three four five six seven", None, "s"),
    (5, "one two three four five six seven", None, "s"), (6, "word " * 60_000, "en", "s"), (None, "one two three four five six seven", "en", "s"), (7, "é́ \U0001f600 ▁ \x1c\x85 <|endoftext|>", "fr", None), (8, "12 34 !!", "fr", "s"),
]


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string, source string")
    extra = {c: "x" for c in ("id", "key", "n", "__id", "k1", "weight", "label", "grp", "length", "payload", "score", "rep", "media", "gone", "again")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
