import pytest

#: Columns whose names operators use inside.
DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, row string, base string, fp string, spans string, `own id` string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bend tonight"


def rows(texts, start=0):
    return [(i, t, "en", "s", None if t is None else len(t), "k", "h", "r", "b", "f", "s", "o") for i, t in enumerate(texts, start)]


ODD_TEXTS = [None, "", "   \n\t ", "one", PROSE, PROSE, PROSE + ".", "É" * 50 + " \0 ▁ <|endoftext|> 漢字 😀", "a" * 40_000, " ".join(f"w{i % 97}" for i in range(20_000)), "x\r\ny z"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long, equal and strange texts, a repeated row and a null id."""
    data = rows(ODD_TEXTS)
    return spark.createDataFrame([*data, data[4], (None, *data[4][1:])], DDL)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
