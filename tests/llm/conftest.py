import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as documents with columns whose names operators use themselves."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        for c in ("node", "keys", "n", "row", "score", "shard", "fp", "size", "c", "h", "w", "gone_id", "lang", "y"):
            if c not in df.columns:
                df = df.selectExpr("*", f"'clash' as {c}")
        return df

    return make


#: Texts that every operator has to bear.
HARD = [None, "", " \n\t ", "one", "one two", "é" * 10, "a" * 30000, "word " * 20000, "\x00\x1c", "日本語 テキスト", "<|im_end|>", "x"]


@pytest.fixture(scope="session")
def hard(frame):
    return frame([(i, t) for i, t in enumerate(HARD)] + [(None, "null id"), (3, "one"), (3, "other text of one id")])


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
