import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def ready(spark):
    from shopmetrics.llm.frames import python_ready

    python_ready(spark)
    return spark


@pytest.fixture(scope="session")
def docs(ready):
    """rows -> documents with a column whose names clash with what operators call theirs."""
    schema = "doc_id long, text string, lang string, source string, key string, id string, row long, family int, bucket int"

    def make(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 3 else ("en", "s")), "k", "x", 1, 2, 3) for r in rows]
        return ready.createDataFrame(full, schema).repartition(3)

    return make


SPECIAL = ["", None, " ", "\n\t", "a", "é", "A a A", "the " * 3000, "x" * 5000, "ß中🙂 'twas it's  we'll\r\n\x85 end "]
