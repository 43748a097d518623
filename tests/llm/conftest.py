import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, source]) tuples, over several partitions, with columns
    whose names the operators use themselves."""
    def make(rows, parts=3, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        if extra:
            for name in ("row", "copies", "hash_", "toxicity", "Score", "shard", "bucket", "term", "_id", "label"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make
