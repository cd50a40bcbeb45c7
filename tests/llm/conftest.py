import pytest



@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, ...) rows, with columns whose names clash with the operators' own."""

    def make(rows, clash=True):
        frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return frame.selectExpr("*", "'x' as lang", "1 as pos", "2 as h1", "3 as keep", "4 as version", "5 as c", "6 as key") if clash else frame

    return make


#: Texts that every operator must take.
ODD = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, "é ü ñ 中文 😀"),
    (None, "a line of no one that is long"), (7, "word " * 3000), (8, "x" * 20000), (9, "a line that repeats here\n" * 50), (10, "\x00\x01<|user|>"),
]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([(1, "x")]).where("doc_id < 0")


