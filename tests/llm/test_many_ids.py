"""Ids of any kind beyond the limit of broadcasts (operators 7 and the pipeline)."""

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cluster, exact_dedup

KINDS = {"dense": "id", "wide": "id * 1000003000017 - 77", "text": "concat('doc-', id)"}


@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize("null", [False, True])
def test_without(spark, monkeypatch, kind, null):
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    docs = spark.range(5000).select(F.expr(KINDS[kind]).alias("id"), F.lit("t").alias("text"), F.lit(1).alias("_n"), F.lit(2).alias("_key"))
    docs = docs.unionByName(docs.limit(2).withColumn("id", F.lit(None).cast(docs.schema["id"].dataType)))
    gone = spark.range(0, 5000, 3).select(F.expr(KINDS[kind]).alias("id"))
    gone = gone.union(spark.range(1).select(F.lit(None).cast(gone.schema["id"].dataType))) if null else gone
    left = cluster.without(docs, "id", gone)
    assert left.columns == docs.columns
    known = {r[0] for r in gone.collect()}
    assert sorted(r["id"] or "" if kind == "text" else r["id"] or 0 for r in left.collect()) == sorted((r["id"] or "") if kind == "text" else r["id"] or 0 for r in docs.collect() if r["id"] not in known)


def test_few_other_rows_get_through(spark):
    ids = cluster.cut(spark.range(0, 200_000, 100).select(F.col("id").cast("string").alias("i")))
    both, perhaps = cluster.perhaps_in(spark.range(200_000).select(F.col("id").cast("string").alias("k")), "k", ids)
    assert 2000 <= both.where(perhaps).count() <= 2000 + 198_000 * 0.01
    plan = both.where(perhaps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_exact_dedup_of_many_ids(spark, docs, edge, monkeypatch):
    """No text of a row that stands alone is hashed, and none is shuffled."""
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    for df in (docs, edge):
        got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()]
        plain = [x[:4] for x in brute.exact([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])]
        assert sorted(map(repr, got)) == sorted(map(repr, plain))
    alone = exact_dedup.exact_dedup(docs).where("text_hash IS NULL").count()
    assert alone >= 0.9 * docs.count() - 40
