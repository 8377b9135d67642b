import pytest

# Rows that no operator may stumble over: null and blank texts, null ids, repeats, ties, one very long text, and
# columns whose names operators use inside.
EXTRA = "lang string, source string, n_chars long, node string, sig string, _t string, _id string, _dropped_id string, _secret_id string, score string, `key` string"


@pytest.fixture(scope="session")
def odd_rows():
    long_text = " ".join(f"w{i % 5003}" for i in range(120_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "null id here is a text"),
        (None, None), (6, long_text), (7, long_text + " tail"), (8, "ß 中文 🙂\x00 end"), (9, "Word, word; WORD"),
        (10, "x" * 50_000), (11, "\r\n\x0b\x0c\x85\xa0 a"), (-3, "null id here is a text"),
    ]
    return [(i, t, None, "s" if i != 4 else None, None, *["clash"] * 8) for i, t in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, " + EXTRA)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
