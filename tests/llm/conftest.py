import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, lang) rows, dealt over three partitions."""

    def build(rows):
        whole = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(whole, DOCS).repartition(3)

    return build


#: nulls, nothing, white space, no letters, ties, repeated rows, a null id, many alphabets.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "12345 !!"), (5, "a"), (6, "a"), (6, "a"), (None, "no id here at all, really none"), (7, "日本語のテキスト 🎉 ñandú"), (8, "word " * 30000),
    (9, "one two three four five six seven eight"), (10, "one two three four five six seven eight"), (11, "x" * 50000), (12, "\x1c\x85  odd\x00spaces"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
