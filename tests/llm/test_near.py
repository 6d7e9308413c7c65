"""The near stage's SimHash step, alone and against a brute-force version."""

import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import similar


def texts():
    rnd, found = random.Random(4), []
    for _ in range(12):  # long texts, each with copies of one word changed: fingerprints a few bits apart
        base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        for _ in range(4):
            found.append(" ".join(base))
            base[rnd.randrange(len(base))] = f"n{rnd.randrange(10**6)}"
    return found + [f"alone {k} among the others here" for k in range(10)] + ["", None, "Two Words", "two  words"]


def test_fingerprints_find_pairs_within_the_radius(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    nodes = similar.prefixes(df, "doc_id", "text", 5, 0.8).select("id", "node", "fingerprint")
    node = {r["id"]: r["node"] for r in nodes.collect()}
    prints = {node[i]: brute.fingerprint(t, 5) for i, t in enumerate(given)}
    assert {r["node"]: r["fingerprint"] % 2**64 for r in nodes.collect()} == prints
    got = {tuple(r) for r in similar.fingerprint_pairs(nodes.select("node", "fingerprint").distinct()).collect()}
    near = {(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= similar.RADIUS}
    assert len(near) > 10 and got == near


def test_near_stage_links_by_fingerprints(spark, monkeypatch):
    """Without any prefix the step still groups what SimHash finds and whole sets verify; the exact search adds the others."""
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    root = brute.alike(given)
    kept = lambda: {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect()}
    whole = kept()
    assert whole == {i for i in range(len(given)) if root[i] == i}
    prefixes = similar.prefixes
    monkeypatch.setattr(similar, "prefixes", lambda *args: prefixes(*args).withColumn("keys", F.array().cast("array<bigint>")))
    alone = kept()
    copies = {i for i in range(len(given)) if given[i] == "two  words" or given[i] is None}
    assert whole <= alone < set(range(len(given))) - copies
