import random
import time
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from edges import EDGE, SCHEMA
from pyspark.sql import functions as F

from tidemark.llm import chat, cluster, exact_dedup, html_text, licenses, mixing, packing, quality, queries, sharding, similar, simhash, token_counts
from tidemark.llm.cluster import components, positions

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(values):
    return sorted(map(repr, values))


# helpers


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(7)
    got = positions(df, "k", "v").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000)) and [(r["k"], r["v"]) for r in got] == sorted((i % 3, i) for i in range(1000))
    assert positions(df.limit(0), "k", "v").count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {x: root(x) for x in up}


# 1


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\e \\\\ <|im_end|>\n", "<<SYS>>", "<<|im_start|>", "", None, "a\nb", "[\\INST]", "<|image|>", "\\\\<s>", "漢😀"]
    given = [(i % 4, i, "assistant" if i % 2 else ("us er\n<s>" if i == 2 else None), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df, chat.text_part(F.col("text")))
    read = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    for r in read:
        mine = [x for x in given if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["loss"] == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(mine) == r["n_turns"]
    assert out.limit(0).count() == 0 and chat.format_chat(df.limit(0), chat.text_part(F.col("text"))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|im_", None, None), ("text", "end|> ", None, None), ("image", None, "a.png", 256), ("video", None, "b", None), ("text", None, None, None), ("audio", "x", None, 9)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = chat.format_chat(df, F.col("parts")).first()
    assert [tuple(a) for a in got["attachments"]] == [("image", "a.png", 256), ("document", "b", 0), ("audio", None, 9)] and got["expanded_tokens"] == 265 and got["n_turns"] == 3
    assert "<|image|><|document|><|audio|>" in got["formatted"]
    turns = spark.range(1).select(chat.read_turns(F.lit(got["formatted"])).alias("t")).first()["t"]
    assert turns[0]["text"] == "see <|im_end|> <|image|><|document|><|audio|>"


@pytest.mark.parametrize("name", ["op1_chat_format", "op7_exact_dedup"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, relation = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    assert key([r[c] for c in columns] for r in df.collect()) == key([r[i] for i in place] for r in relation.fetchall())


# 2


def shards_of(df, **how):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    dims = {"source": F.col("source"), "n_chars": sharding.number_place(F.col("n_chars"))}
    return sharding.kd_shards(df, size, dims, **how)


def test_sharding(spark, docs):
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    for df in (docs, hot):
        out = shards_of(df, shards=16).collect()
        size, slots = Counter(), defaultdict(list)
        for r in out:
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(out) == 200 and set(size) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        mean = sum(size.values()) / 16
        assert max(abs(x - mean) for x in size.values()) <= max(r["size"] for r in out)
        assert key(out) == key(shards_of(df, shards=16).collect())
    assert {r["shard"] for r in shards_of(docs, target_bytes=60_000).collect()} == set(range(-(-sum(size.values()) // 60_000)))


def test_sharding_splits_along_the_widest(spark):
    df = spark.range(64).select("id", F.lit(1).alias("size"), (F.col("id") % 8).cast("double").alias("x"), (F.col("id") / 1000).alias("y"))
    out = sharding.kd_shards(df, F.col("size"), {"y": F.lit(0.0), "x": F.col("x")}, id_col="id", shards=8, carry=("x",))
    assert all(len({r["x"] for r in out.collect() if r["shard"] == s}) == 1 for s in range(8))


def test_sharding_keeps_groups(spark, docs):
    same = lambda k, text, n: [(k + i, text, f"s{i % 5}", len(text)) for i in range(n)]
    given = same(0, "x" * 1500, 40) + same(100, "y" * 9000, 90) + same(500, "", 800) + same(2000, "z" * 70, 60) + [(5000 + i, f"text {i} " * (i % 90), f"crawl-2023-{i % 7}", i % 90) for i in range(3000)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, n_chars long").repartition(5)
    for rows_, over in ((df, {"y" * 9000}), (docs, set())):
        out = shards_of(rows_, shards=16, group=F.coalesce("text", F.lit(""))).collect()
        text, of, size = dict(rows(rows_.select("doc_id", "text"))), defaultdict(set), Counter()
        for r in out:
            of[text[r["doc_id"]] or ""].add(r["shard"])
            size[r["shard"]] += r["size"]
        assert {t for t, s in of.items() if len(s) > 1} == over and len(out) == rows_.count() and set(size) == set(range(16))
        mean = sum(size.values()) / 16
        assert max(abs(x - mean) for x in size.values()) <= max(r["size"] for r in out) + mean / 16


def test_large_groups_are_placed_in_rounds(spark):
    rnd = random.Random(8)
    sizes = {i: rnd.choice([3, 10, 10, 25, 60, 90]) for i in range(40)} | {100: 5000}
    large = spark.createDataFrame(list(sizes.items()), "group long, size long")
    given, rooms = sharding._placed_in_rounds(large, spark.range(9).select(F.col("id").cast("int").alias("leaf"), F.lit(100.0).alias("room")))
    to, left = dict(rows(given)), dict(rows(rooms))
    assert set(to) == set(sizes) and to[100] == -1 and set(left) == set(range(9))
    assert left == {s: 100.0 - sum(sizes[g] for g, x in to.items() if x == s) for s in range(9)} and min(left.values()) >= 0
    assert all(sizes[g] > max(left.values()) for g, x in to.items() if x == -1)


def test_sharding_without_the_driver(spark, docs, monkeypatch):
    """With no node, group or shard known to the driver: groups whole, shards near their share."""
    monkeypatch.setattr(sharding, "NODES", 0)
    monkeypatch.setattr(sharding, "_placed", None)
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    out = shards_of(docs, shards=5, group=F.coalesce("text", F.lit(""))).collect()
    text, of, size, slots = dict(rows(docs.select("doc_id", "text"))), defaultdict(set), Counter(), defaultdict(list)
    for r in out:
        of[text[r["doc_id"]] or ""].add(r["shard"])
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(out) == docs.count() and all(len(x) == 1 for x in of.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(abs(x - sum(size.values()) / 5) for x in size.values()) <= max(r["size"] for r in out) + sum(size.values()) / 80


def test_many_shards_do_not_reach_the_driver(spark, monkeypatch):
    """2,000 shards, known to the driver by counts: what it collects does not grow with shards or rows."""
    df = spark.range(8000).select("id", F.lit(10).alias("size"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    collected, collect = [], type(df).collect

    def counted(self):
        got = collect(self)
        collected.append(len(got))
        return got

    monkeypatch.setattr(sharding, "NODES", 100)
    monkeypatch.setattr(type(df), "collect", counted)
    out = sharding.kd_shards(df, F.col("size"), {"x": F.col("x"), "y": F.col("y")}, id_col="id", target_bytes=40)
    assert max(collected, default=0) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = Counter(r["shard"] for r in collect(out))
    assert set(sizes) == set(range(2000)) and sum(sizes.values()) == 8000 and 1 <= min(sizes.values()) and max(sizes.values()) <= 8


def test_sharding_against_a_plain_tree(spark):
    rnd = random.Random(6)
    items = [(i, rnd.randrange(1, 50), rnd.random(), float(rnd.randrange(9)), "abc"[rnd.randrange(3)] * rnd.randrange(1, 9)) for i in range(700)]
    df = spark.createDataFrame(items, "id long, size long, x double, y double, s string")
    out = {r["id"]: r["shard"] for r in sharding.kd_shards(df, F.col("size"), {"x": F.col("x"), "y": F.col("y"), "s": F.col("s")}, id_col="id", shards=8).collect()}
    rank = {v: float(i) for i, v in enumerate(sorted({x[4] for x in items}))}
    assert brute.kd_tree_fits([(x[0], x[1], (x[2], x[3], rank[x[4]])) for x in items], out, 8)


def test_sharding_edges(edge, nothing):
    out = shards_of(edge, shards=4).collect()
    assert len(out) == len(EDGE) and sum(r["size"] for r in out) == sum(len((t or "").encode()) + 1 for _, t, _, _ in EDGE)
    assert shards_of(nothing, shards=4).count() == 0


# 3


def page(*parts):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'>" + "".join(parts) + "</body></html>"


def text_of(html, *low):
    return html_text.main_text(html, *low)[0]


def test_html_text():
    noise = "<header>h</header><nav><ul><li><a href=x>menu</a></ul></nav><div class='ad box'>buy</div><aside>s</aside><div id=cookie-notice>c</div><form><p>f<input></form><section class=comments><p>r</section><footer>&copy;</footer><p hidden>x</p><script>var a='</p>';</script><!-- <p>no -->"
    want = "Title & more\nfoo bar é\nlast one\n1\n2"
    article = "<article><h1>Title &amp;\n more</h1><p><b>foo</b>\t bar &eacute;<p>last<br>one<aside>no</aside><table><tr><td>1<td>2</table></article>"
    assert text_of(page(noise, article, noise)) == want
    assert text_of(page(noise, article.replace("article>", "div>"), noise)) == want
    assert text_of(page("<form>", article, "</form>")) == want
    assert html_text.main_text("") == ("", 0) and text_of("a < b &amp; <") == "a < b & <"
    assert text_of("<p title='never closed>x") == "x" and text_of("<script>x") == ""
    assert text_of("<div>" * 3000 + "deep") == "deep" and text_of("<div>" * 3000 + "deep", "h", html_text.Low(frozenset([b"x" * 8]))) == "deep"
    assert text_of("<article><ul><li><a href=x>all links</a><li><a href=y>of an article</a></ul></article>") == "all links\nof an article"


def words_of(i, n=8):
    return " ".join(f"w{i}x{j}" for j in range(n))


SITES = [
    *[(i, f"https://Site.example.org/{i}", page("<div class=top><p>Welcome to us</p><p>Call now</p></div>", f"<div class=text><p>{words_of(i)}</p><p>{words_of(-i - 1)}</p></div>", "<div class=low><p>All rights</p></div>")) for i in range(8)],
    *[(100 + i, "http://copies.example.org/", page("<div class=text><p>same words</p></div>")) for i in range(6)],
    (200, "http://lone.example.org/", page("<div class=top><p>Welcome to us</p></div>")), (201, None, None), (201, None, None),
    *[(300 + i, "http://notes.example.org/", page(f"<article><p>{words_of(i, 30)}</p><div class=box{i}><p>Get our letter</p></div><p>{words_of(-i - 1, 30)}</p>{'<p>a passage of some</p>' if i % 3 == 0 else ''}</article>")) for i in range(20)],
    *[(400 + i % 6, "http://again.example.org/", page(f"<div class=ad>{i}</div><article><h1>once</h1><p>{words_of(i % 2)}</p></article>")) for i in range(12)],
    *[(500 + i, "http://teaser.example.org/", page(f"<div class=story><p>{words_of(i, 40)}</p><p>{words_of(-i - 1, 40)}</p></div><div class=teaser><article>read {i} too</article></div>")) for i in range(9)],
]


@pytest.mark.parametrize("names", [html_text.NAMES, -1])
def test_style_tree(spark, monkeypatch, names):
    monkeypatch.setattr(html_text, "NAMES", names)  # -1: each page looks up its own names
    df = spark.createDataFrame(SITES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "paths", "path", "id", "k", "text", "tree_host", "branches", "high", "place")})
    got = defaultdict(list)
    for r in html_text.extract(df).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
    assert all(got[i] == [(f"{words_of(i)}\n{words_of(-i - 1)}", len(words_of(i)) + len(words_of(-i - 1)) + 1)] for i in range(8))
    assert got[100] == [("same words", 10)] and got[200] == [("Welcome to us", 13)] and got[201] == [("", 0)] * 2
    # a notice on all pages goes, though it stands in the article; a passage of some of them stays
    assert all(got[300 + i][0][0] == f"{words_of(i, 30)}\n{words_of(-i - 1, 30)}" + ("\na passage of some" if i % 3 == 0 else "") for i in range(20))
    assert all("Get our letter" in text_of(h) for i, _, h in SITES if 300 <= i < 320)  # with an empty tree it stays
    assert all(x == (f"once\n{words_of(i % 2)}", 5 + len(words_of(i % 2))) for i in range(6) for x in got[400 + i])  # pages that repeat whole articles
    assert all(got[500 + i][0][0].startswith(f"{words_of(i, 40)}\n{words_of(-i - 1, 40)}") for i in range(9))  # the text stands beside a teaser
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [None, SF])
def test_style_tree_against_brute_force(spark, sf):
    df = spark.createDataFrame(SITES, "page_id long, url string, html string") if sf is None else spark.read.parquet(f"{sf}/pages.parquet")
    pages = [(r["host"], r["html"] or "") for r in df.select(html_text.host("url").alias("host"), "html").collect()]
    want = brute.style_trees(pages)
    got = {r["tree_host"]: html_text.Low(*[frozenset(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r[c])) for c in html_text.Low._fields]) for r in html_text.low_by_host(html_text.style_names(df.select(html_text.host("url").alias("host"), "html"))).collect()}
    empty = html_text.Low()
    assert {h: x for h, x in got.items() if x != empty} == {h: x for h, x in want.items() if x != empty}
    texts = key((r["page_id"], r["text"]) for r in (html_text.extract(df) if sf is None else queries.op3_html_text(spark, sf)).collect())
    assert texts == key((r["page_id"], text_of(r["html"] or "", h, want.get(h, empty))) for r, (h, _) in zip(df.collect(), pages, strict=True))


def test_pages_look_up_their_names(spark, monkeypatch):
    """No host's names are gathered beyond NAMES, and hot names are split; the texts are the same."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = key(map(tuple, html_text.extract(df).collect()))
    monkeypatch.setattr(html_text, "NAMES", -1)
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(html_text, "low_by_host", None)
    assert key(map(tuple, html_text.extract(df).collect())) == want


def test_very_long_page(spark):
    long = page("<article>", *[f"<p>paragraph {i}" for i in range(60_000)], "<div>" * 2000, "end", "</article>")
    df = spark.createDataFrame([(1, "http://a.b/", long), (2, "http://a.b/", "<p>x")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {1: "\n".join([f"paragraph {i}" for i in range(60_000)] + ["end"]), 2: "x"}


# 4


def check_packing(given, out, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    want = Counter(tuple(t.encode(x or "", add_special_tokens=False).ids + [1]) for _, x in given)
    by, seen = defaultdict(list), Counter()
    for r in out:
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    stream = []
    for s in sorted(by):
        at = 0
        for r in sorted(by[s], key=lambda r: r["offset"]):
            ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert r["offset"] == at and len(ids) == r["length"] > 0
            at += r["length"]
            stream.append((r, ids))
        assert at == window or s == max(by)
    whole = []
    for r, ids in stream:
        whole = ids if r["start"] == 0 else whole + ids
        assert r["start"] == len(whole) - len(ids)
        if len(whole) == r["doc_tokens"]:
            seen[tuple(whole)] += 1
    assert seen == want


def test_packing(spark, docs, edge, nothing):
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs).collect(), 2048)
    check_packing([(i, t) for i, t, _, _ in EDGE], packing.pack(edge, window=100).collect(), 100)
    assert packing.pack(nothing).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    rnd, t, mine = random.Random(2), Tokenizer.from_file(packing.default_path()), packing.WordIds(packing.default_path())
    letters = [*"  aAbcdeÉéßΣσς'stl,.!$<|>_0123\n\t\x1f\x00İŉ漢😀ﬁ́ ", "<|endoftext|>", "don't", "’s"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 5, 10, 40]))) for _ in range(3000)]
    ids, n = packing.encode(pa.array(texts), mine, 1)
    want = [x.ids + [1] for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


# 5


def test_licenses(spark, docs):
    notices = {"Apache": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the terms of the MIT License.", "GPL": "This work is licensed under GNU General Public License, version 2.", "CC BY-NC": "Licensed under CC BY-NC 3.0.", "BSD": "Released under the BSD 2-Clause License."}
    plain = [(i, "A licensed driver released the brakes under the bridge.\nThe general public works here.\nAll rights reserved.") for i in range(100, 110)]
    planted = [(i, f"Some text first.\n{n}\nand after.", f) for i, (f, n) in enumerate(notices.items())]
    edges = [(500, None), (501, ""), (None, notices["MIT"]), (502, "word " * 200_000 + "\n" + notices["GPL"]), (502, "word " * 200_000 + "\n" + notices["GPL"])]
    rest = docs.where("doc_id < 60").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    df = spark.createDataFrame(plain + [x[:2] for x in planted] + edges, "doc_id long, text string").unionByName(rest).withColumns({c: F.lit(1) for c in ("id", "words", "p", "family", "count")})
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert {i: got[i]["licences"] for i, _, _ in planted} == {i: [f] for i, _, f in planted}
    assert all(not got[i]["licences"] for i, _ in plain) and not got[500]["licences"] and not got[501]["licences"]
    assert got[None]["licences"] == ["MIT"] and got[502]["licences"] == ["GPL"] and got[502]["n_notices"] == 2
    marked = {r["doc_id"] + 1000 for r in docs.where("doc_id < 60").where("text LIKE '%icensed under%' OR text LIKE '%eleased under the%'").collect()}
    assert {i for i in got if i is not None and i >= 1000 and got[i]["licences"]} == marked
    assert licenses.scan(df.limit(0)).count() == 0


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "EPL": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
}


def test_wrapped_licenses(spark, docs):
    prose = [r["text"] for r in docs.where("doc_id < 200 AND length(text) > 500 AND text NOT ILIKE '%licen%' AND text NOT ILIKE '%released%'").collect()]
    alone = [(i, f"Copyright (c) 2020\n\n{n}\n", [f]) for i, (f, n) in enumerate(WRAPPED.items())]
    amid = [(100 + i, "\n".join([*prose[i].split("\n"), *(f" * {x}" for x in n.split("\n")), *prose[i + 1].split("\n")]), [f]) for i, (f, n) in enumerate(WRAPPED.items())]
    two = [(200, f"{WRAPPED['BSD']}\n\n{WRAPPED['GPL']}", ["BSD", "GPL"]), (201, "You may use it under the MIT License.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", ["Apache", "MIT"])]
    plain = [(300 + i, t, []) for i, t in enumerate(prose[20:60])] + [(400, "The license plate was released.\nPermission was granted to distribute the copyright notices.", []), (401, "All rights reserved. Redistribution of wealth is not software.", [])]
    given = alone + amid + two + plain
    df = spark.createDataFrame([x[:2] for x in given], "doc_id long, text string")
    assert {r["doc_id"]: r["licences"] for r in licenses.scan(df).collect()} == {i: f for i, _, f in given}


# 6


def test_quality_counters(edge):
    got = key((r["doc_id"], *(r[c] for c in quality.COUNTERS)) for r in quality.judge(edge).collect())
    assert got == key((i, *brute.counters(t)) for i, t, _, _ in EDGE)


def test_quality_repeats():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("ab" if k % 2 else "abcdefg") for _ in range(rnd.randrange(60))) + rnd.choice(["", "\n", "\nx\nx\n \n"]) for k in range(400)]
    got = quality.features(pa.array(texts), ["en"] * len(texts))
    assert [tuple(int(got[c][i]) for c in quality.COUNTERS) for i in range(len(texts))] == [brute.counters(t) for t in texts]


def test_quality_verdict(docs, nothing):
    given = rows(docs.select("doc_id", "text", "lang"))
    want = brute.verdicts(given, quality.Limits(), quality.COMMON, quality.CLASSES)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert got == {i: k for (i, _, _), k in zip(given, want, strict=True)} and 0 < sum(want) < len(want)
    assert key(quality.accepted(docs).collect()) == key(r for r in docs.collect() if got[r["doc_id"]])
    assert quality.judge(nothing).count() == 0 and quality.accepted(nothing).count() == 0
    twice = docs.select(F.floor(F.col("doc_id") / 2).alias("doc_id"), "text", "lang", F.col("doc_id").alias("was"))
    assert {r["was"] for r in quality.accepted(twice).collect()} == {i for i, k in got.items() if k}


def test_quality_spares_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("NOT base_failed").join(labels, "doc_id")
    share = {r["quality"]: r["share"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_quality_ignores_hot_copies(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    alone = {r["doc_id"]: r for r in quality.judge(df).collect()}
    far = max((r for r in alone.values() if r["kept"] and r["n_words"] >= 45), key=lambda r: r["word_distance"] or 0)["doc_id"]
    hot = df.where(F.col("doc_id") == far).crossJoin(spark.range(2 * len(alone)).withColumnRenamed("id", "k"))
    copies = hot.select((-1 - F.col("k")).alias("doc_id"), "text", "lang")
    crowd = {r["doc_id"]: r["kept"] for r in quality.judge(df.unionByName(copies)).collect()}
    assert {i: crowd[i] for i in alone} == {i: r["kept"] for i, r in alone.items()}
    assert all(k == alone[far]["kept"] for i, k in crowd.items() if i < 0)
    near = hot.select((-1 - F.col("k")).alias("doc_id"), F.concat_ws(" ", "text", F.concat(F.lit("copy"), "k")).alias("text"), "lang")
    crowd = {r["doc_id"]: r["kept"] for r in quality.judge(df.unionByName(near)).collect()}
    assert sum(crowd[i] != r["kept"] for i, r in alone.items()) <= 0.002 * len(alone)


# 7


def test_exact(edge, nothing):
    marked = edge.withColumn("sha", F.sha2(exact_dedup.normal(F.col("text")), 256))
    got = exact_dedup.exact_dedup(marked, carry=("sha",), prefix=8)
    assert key(rows(got.select("doc_id", "keep_id", "group_size", "kept", "sha"))) == key(brute.exact([(i, t) for i, t, _, _ in EDGE]))
    kept = key(i for i, _, _, k, _ in brute.exact([(i, t) for i, t, _, _ in EDGE]) if k)
    left = exact_dedup.survivors(edge)
    assert left.columns == edge.columns and key(r["doc_id"] for r in left.collect()) == kept
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.survivors(nothing).count() == 0
    odd = edge.withColumn("m", F.create_map(F.lit("a"), F.monotonically_increasing_id()))  # a type without order
    assert key(r["doc_id"] for r in exact_dedup.survivors(odd).collect()) == kept


def test_exact_beyond_broadcasts(spark, docs, monkeypatch):
    stay = exact_dedup.survivors(docs).collect()
    want, given = key(stay), rows(docs.select("doc_id", "text"))
    assert key(r["doc_id"] for r in stay) == key(i for i, _, _, k, _ in brute.exact(given) if k)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    for bitmaps in (cluster.BITMAPS, 0):
        monkeypatch.setattr(cluster, "BITMAPS", bitmaps)
        assert key(exact_dedup.survivors(docs).collect()) == want


def test_without(spark, monkeypatch):
    ids = [None, -5, 0, 1, 2, 7, 8, 32767, 32768, 32769, 10**12]
    df = spark.createDataFrame([(i, str(i)) for i in ids for _ in range(2)], "doc_id long, _id string").repartition(3)
    for gone in ([], [None], [0, 7, 32768], [-5, 1, 10**12, None]):
        out = []
        for most, bitmaps in ((100, 9), (-1, 9), (-1, 0)):
            monkeypatch.setattr(cluster, "BROADCAST_ROWS", most)
            monkeypatch.setattr(cluster, "BITMAPS", bitmaps)
            left = cluster.without(df, "doc_id", spark.createDataFrame([(i,) for i in gone], "x long"))
            assert left.columns == df.columns
            out.append(key(left.collect()))
        assert out == [key(r for r in df.collect() if r["doc_id"] not in gone)] * 3


# 8


def test_simhash(spark, docs, edge, nothing):
    given = [(i, t) for i, t, _, _ in EDGE]
    assert key(rows(simhash.near_groups(edge))) == key(brute.near(given))
    texts = rows(docs.select("doc_id", "text"))
    assert key(rows(simhash.near_groups(docs))) == key(brute.near(texts))
    left = simhash.survivors(docs, shingle=5)
    assert key(r["doc_id"] for r in left.collect()) == key(i for i, _, c in brute.near(texts, 5) if i == c) and left.columns == docs.columns
    assert simhash.near_groups(nothing).count() == 0 and simhash.survivors(edge).columns == edge.columns


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links_in_dense_clusters(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd, prints = random.Random(4), set()
    for _ in range(12):
        center = rnd.getrandbits(64)
        for _ in range(60):
            x = center
            for b in rnd.sample(range(64), rnd.randrange(5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"))
    labels = dict(rows(components(found)))
    mine, want = defaultdict(set), defaultdict(set)
    for i, c in enumerate(brute.groups(prints)):
        want[c].add(i)
        mine[labels.get(signed[i], signed[i])].add(i)
    assert key(map(sorted, mine.values())) == key(map(sorted, want.values()))
    assert all((u ^ v).bit_count() <= 2 for u, v in ((a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in rows(found)))


# 9


def test_token_counts(edge, nothing):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=token_counts.default_path())
    rnd, merges = random.Random(1), token_counts.merges_of(token_counts.default_path())
    letters = "   aaabcdehlo\n\n\t▁éß漢字😀.,!<s>'0123</s>thingeŕ\x1f\x00 "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 5, 10, 40, 200]))) for _ in range(4000)] + ["a" * 5000, " " * 3000, "\n" * 50, "ab" * 4000, "   x", "x   ", "\n x", "", "".join(rnd.choice("abcdefghij0123") for _ in range(20_000))]
    assert token_counts.counts(pa.array(texts), merges).tolist() == [len(x) for x in sp.encode(texts, num_threads=1)]
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _, _ in EDGE]
    assert key(rows(token_counts.count_tokens(edge))) == key(want)
    assert token_counts.count_tokens(nothing).count() == 0


def test_token_counts_of_very_long_words():
    from sentencepiece import SentencePieceProcessor

    rnd, merges = random.Random(8), token_counts.merges_of(token_counts.default_path())
    kinds = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "etaoinshr"]
    began, texts = time.process_time(), ["".join(rnd.choices(k, k=1_000_000)) for k in kinds]
    got = token_counts.counts(pa.array(texts), merges).tolist()
    assert time.process_time() - began < 60
    sp = SentencePieceProcessor(model_file=token_counts.default_path())
    assert got == [len(x) for x in sp.encode(texts, num_threads=1)]


# 10


def check_mix(given, out):
    sizes, by = Counter(), defaultdict(list)
    for _, t, s in given:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes)
    for r in out:
        by[r["source"]].append(r)
    for s, docs in by.items():
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 2 for r in docs)
        taken, least = sum(r["copies"] * r["size"] for r in docs), min((r["size"] for r in docs if r["size"]), default=0)
        assert abs(taken - want[s]) <= max(least, 0.005 * want[s])
    assert len(out) == len(given)


def test_mixing(spark, docs, nothing):
    given = rows(docs.select("doc_id", "text", "source"))
    out = mixing.mix(docs).collect()
    check_mix(given, out)
    assert key(out) == key(mixing.mix(docs.repartition(5)).collect())
    hot = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 3 else f"s{i % 40}") for i in range(3000)] + [(9000 + i, "same words here", None) for i in range(500)], "doc_id long, text string, source string")
    check_mix(rows(hot), mixing.mix(hot).collect())
    times = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert times == {r["doc_id"]: r["copies"] for r in out if r["copies"]} and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_mixing_edges(edge):
    out = mixing.mix(edge).collect()
    assert len(out) == len(EDGE) and all(0 <= r["copies"] <= 2 for r in out)
    assert set(mixing.mixed(edge).columns) == set(edge.columns)


def test_mixed_with_shared_ids(spark):
    given = [(i % 50, " ".join(["w"] * (5 + i % 13)), "ab"[i % 2], i) for i in range(300)] + [(None, "the same words", "b", 0)] * 41
    df = spark.createDataFrame(given, "doc_id long, text string, source string, n long").repartition(4)
    sizes, taken = Counter(), Counter()
    for _, t, s, _ in given:
        sizes[s] += len(t.split())
    out = mixing.mixed(df).collect()
    for r in out:
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - x) <= 9 for s, x in brute.targets(sizes).items())
    assert max(Counter(tuple(r) for r in out if r["doc_id"] is not None).values()) <= 2 and key(out) == key(mixing.mixed(df.repartition(2)).collect())


def test_mixing_tilts_by_size(docs):
    """Within a source the logarithm of the rate, below the cap, is in proportion to the size."""
    by = defaultdict(list)
    for r in mixing.mix(docs).collect():
        if r["size"] and 0 < r["rate"] < 1.999:
            by[r["source"]].append(np.log(r["rate"]) / r["size"])
    assert by and all(np.ptp(x) < 1e-6 for x in by.values())


# pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    given = rows(docs.select("doc_id", "text", "lang"))
    good = [(i, t) for (i, t, _), k in zip(given, brute.verdicts(given, quality.Limits(), quality.COMMON, quality.CLASSES), strict=True) if k]
    ids = {i for i, _, _, k, _ in brute.exact(good) if k}
    left = [x for x in good if x[0] in ids]
    ids = {i for (i, _), c in zip(left, brute.alike([t for _, t in left]), strict=True) if i == left[c][0]}
    out = corpus_pipeline.run(spark, SF).collect()
    source = dict(rows(docs.select("doc_id", "source")))
    left = [(i, t, source[i]) for i, t in good if i in ids]
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += len(brute.WORD.findall(t))
    want, taken, text = brute.targets(sizes), Counter(), dict(good)
    times = Counter(r["doc_id"] for r in out if r["start"] == 0)
    assert set(times) <= ids and max(times.values()) <= 2
    for i, k in times.items():
        taken[source[i]] += k * len(brute.WORD.findall(text[i]))
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(0.05 * target, min(len(brute.WORD.findall(t)) for _, t, x in left if x == s))
    check_packing([(i, text[i]) for i, k in times.items() for _ in range(k)], out, 2048)


@pytest.mark.parametrize("block", [similar.BLOCK, 7])
def test_near_stage_finds_all_pairs_of_the_similarity(spark, monkeypatch, block):
    import corpus_pipeline

    monkeypatch.setattr(similar, "BLOCK", block)
    if block == 7:
        monkeypatch.setattr(similar, "PAIRS", 50)

    rnd, texts = random.Random(9), []
    line = " ".join(f"common{k}" for k in range(30))
    for k in range(25):  # chains of edits, of sizes that give similarities on both sides of 0.8
        base = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(60)) for _ in range(rnd.randrange(20, 160))]
        for _ in range(6):
            texts.append(" ".join(base) + (" " + line if k % 2 else ""))
            for _ in range(rnd.randrange(1, 4)):
                base[rnd.randrange(len(base))] = f"new{rnd.randrange(10**6)}"
    base = [f"base{k}" for k in range(120)]
    for _ in range(90):  # a dense group of which some are similar, most are nearly so
        texts.append(" ".join(f"x{rnd.randrange(10**6)}" if rnd.random() < 0.04 else w for w in base))
    hot = [f"hot{k}" for k in range(80)]
    texts += [" ".join([*hot, f"end{k}"]) for k in range(120)] + [line] * 5 + ["", None, " ", "two words", "Two  Words", "a b c d e"]
    given = list(enumerate(texts))
    root = brute.alike(texts)
    linked = len(texts) - len(set(root))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    assert linked > 100 and dict(rows(similar.groups(df))) == dict(enumerate(root))
    left = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, SF).collect()}
    assert left == {i for i in range(len(texts)) if root[i] == i}
    twice = spark.createDataFrame([(None, texts[0]), (7, texts[0]), (7, texts[0]), (None, "alone")], "doc_id long, text string")
    assert key(rows(similar.groups(twice))) == key([(None, 7), (7, 7), (7, 7), (None, None)])


def test_empty_pipeline(spark, docs):
    import corpus_pipeline

    df = spark.createDataFrame([], SCHEMA + ", n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_components_by_rounds(spark, monkeypatch, broadcast):
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(cluster, "PART_ROWS", 100)
    path, rng = [(i, i + 1) for i in range(1000, 1200)], random.Random(3)
    edges = path + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(2000, 2000 + i) for i in range(100)]
    least = {x: x for e in edges for x in e}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for u, v in edges:
        u, v = sorted((root(u), root(v)))
        least[v] = u
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = cluster.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(tuple(r) for r in got) == sorted((x, root(x)) for x in linked)
    assert cluster.components(spark.createDataFrame([], "u long, v long")).count() == 0
