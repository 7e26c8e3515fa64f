import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, h string, id string, t string, k string, kept boolean, score string, host_pages string, found string, n_words string, n_lines string, row string, `a.b` string, ids string"


def documents(spark, pairs):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, x, "en", f"src{(i or 0) % 2}", len(x or ""), "a", "b", "c", "d", "e", None, "f", "g", "h", "i", "j", "k", "l", "m") for i, x in pairs]
    return spark.createDataFrame(rows, SCHEMA)


#: Nulls, empty and blank texts, ties, repeated rows, a long text.
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(20_000))
ODD = [
    (0, None), (1, ""), (2, "  \n\t"), (3, "one"), (4, "one"), (5, "One two three four five six"), (6, "one two three four five  six"),
    (6, "one two three four five  six"), (7, LONG), (8, LONG + " end"), (9, "a▁b  c "), (10, "é🙂\r\n\x00x"), (11, LONG), (None, "one"), (None, None)
]


@pytest.fixture
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture
def none(spark):
    return documents(spark, [])
