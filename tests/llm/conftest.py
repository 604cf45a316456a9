import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, label string"


@pytest.fixture
def documents(spark):
    """Documents from (id, text[, source[, lang]]) with further columns whose names operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None, -1, -2, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


@pytest.fixture
def rows_by_id():
    return by_id
