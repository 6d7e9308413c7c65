"""Scans, and operators 11 to 13, against plain versions."""

import gzip
import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from edges import CLASHING, EDGE
from pyspark.sql import functions as F

from tidemark.llm import cluster, phrases, queries, scans, trie, warc

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(values):
    return sorted(map(repr, values))


def test_scan(spark):
    rnd = random.Random(5)
    given = [(None if i % 97 == 0 else "hot" if i % 3 else f"k{rnd.randrange(9)}", rnd.randrange(5), i, rnd.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(given, "k string, o long, id long, v long").repartition(7)
    got = scans.scan(df, ["k"], ["o", "id"], sums=["v"], firsts=["id"], totals=["v"]).collect()
    expected, names, all_before = {}, {}, 0
    ordered = sorted(given, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    groups = defaultdict(list)
    for r in ordered:
        names.setdefault(r[0], len(names))
        groups[r[0]].append(r)
        so_far = groups[r[0]]
        expected[r[2]] = (names[r[0]], len(so_far) - 1, sum(x[3] for x in so_far[:-1]), so_far[0][2], all_before)
        all_before += r[3]
    ends = {g[-1][2] for g in groups.values()}
    assert {r["id"]: (r["name"], r["place"], r["before_v"], r["first_id"], r["above_v"]) for r in got} == expected
    assert {r["id"] for r in got if r["ends"]} == ends
    assert scans.scan(df.limit(0), ["k"], ["id"]).count() == 0


def test_scan_of_one_key_over_many_tasks(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id", F.lit(2).alias("v")).repartition(5)
    got = scans.scan(df, ["k"], ["id"], sums=["v"], firsts=["id"]).collect()
    assert all((r["name"], r["place"], r["before_v"], r["first_id"], r["ends"]) == (0, r["id"], 2 * r["id"], 0, r["id"] == 999) for r in got) and len(got) == 1000


def test_lookup_meets_hot_keys_apart(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 5)
    left = cluster.cut(spark.range(2000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id"))
    right = cluster.cut(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    expected = [(7 if i % 3 else i, i, 14 if i % 3 else 2 * i) for i in range(2000) if i % 3 or i < 1000]
    assert key(rows(cluster.lookup(left, right, ["k"], hot=50))) == key(expected)


# 11


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        enders = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(path))))
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        out.append((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), sum(len(p) == len(path) + 1 for p in below), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(enders.encode()).hexdigest(),
        ))
    return out


def plain_splice(given):
    """given: rows (conv, turn, role, text)."""
    mark = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in given:
        if c is not None:
            own[c].append((turn is not None, turn or 0, mark(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def conversations(spark, given):
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in [*CLASHING, "d", "least", "name", "at", "mark", "base", "conv", "source"]}).repartition(5)


def test_trie(spark):
    rnd = random.Random(11)
    given = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{rnd.randrange(2)}😀") for c in [*range(100, 160), *range(200, 230), -7, -100, 399] for t in range(rnd.randrange(1, 12))]
    given += [(700, t, "user", "x") for t in range(41)] + [(701, t, "user", "x") for t in range(40)]
    given += [(800, None, None, None), (800, 0, "user", "a"), (800, 0, "user", "a"), (800, 0, "", "b"), (801, 3, "user", None), (None, 0, "user", "lost"), (802, 1, "user", "long " * 30_000)]
    rnd.shuffle(given)
    got = trie.nodes(trie.spliced(trie.turns_of(conversations(spark, given))))
    assert key(rows(got)) == key(plain_trie(plain_splice(given)))


def test_trie_of_equal_conversations(spark):
    given = [(1000 + 100 * c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    got = rows(trie.nodes(trie.spliced(trie.turns_of(conversations(spark, given)))))
    assert key(got) == key(plain_trie(plain_splice(given))) and len(got) == 4


def test_trie_of_nothing(spark):
    assert trie.nodes(trie.spliced(trie.turns_of(conversations(spark, [(1, 1, "", "")]).limit(0)))).count() == 0


def test_lists_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    df = spark.range(500).select(F.lit(1).cast("long").alias("d"), (F.col("id") % 2).alias("least"), F.col("id").alias("conv"))
    expected = [(1, k, hashlib.sha256(",".join(str(i) for i in range(k, 500, 2)).encode()).hexdigest()) for k in (0, 1)]
    assert key(rows(trie.list_digests(df))) == key(expected)


# 12


def pages(spark, given, parts=3):
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in [*CLASHING, "ident", "digest", "kind", "file", "order", "body", "plain", "no_id"]}).repartition(parts)


PAGES = [
    (5, "http://a/x", "copy " * 40), (3, "http://b/ü ?q=1\r\nX: y", "copy " * 40), (9, None, "copy " * 40), (None, "http://a/", "copy " * 40), (7, "http://c", ""), (8, "http://c", None), (None, None, None), (None, None, None),
    (11, "http://d", "<p>漢字 😀</p>" * 50), (11, "http://d", "<p>漢字 😀</p>" * 50), (11, "http://e", "<p>漢字 😀</p>" * 50), (12, "http://d", "z" * 99), (13, "http://d", "z" * 99), (14, "http://d", "y" * 100), (15, "http://d", "y" * 100), (16, "", "WARC/1.1\r\n\r\n\r\n" * 20), (17, "http://l", "long\0 " * 200_000),
]


def plain_records(given):
    seen, out = {}, []
    for i, u, h in sorted(given, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        p = (h or "").encode()
        again = len(p) >= 100 and p in seen
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", seen[p] if again else None))
        seen.setdefault(p, i)
    return out


def archive(spark, tmp_path, df, **how):
    folder = str(tmp_path / uuid.uuid4().hex)
    manifest = warc.write_archives(df, folder, **how).collect()
    return folder, sorted(manifest, key=lambda r: r["name"])


def test_warc_round_trip(spark, tmp_path):
    folder, manifest = archive(spark, tmp_path, pages(spark, PAGES))
    got = warc.read_archives(spark, folder).collect()
    number = lambda x: None if x is None else int(x)
    assert key((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in got) == key(plain_records(PAGES))
    texts = [(h or "").encode() for _, _, h in PAGES]
    kept = Counter(bytes(r["payload"]) for r in got if r["record_type"] == "response")
    assert kept == Counter([*{x for x in texts if len(x) >= 100}, *[x for x in texts if len(x) < 100]])
    assert [r["name"] for r in manifest] == ["part-0000000.warc.gz"] and manifest[0]["records"] == len(PAGES)
    data = gzip.decompress(open(f"{folder}/part-0000000.warc.gz", "rb").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and len(set(re.findall(rb"\nWARC-Record-ID: (\S+)", data))) == len(PAGES) + 1
    assert b"\r\nX: y" not in data.split(b"HTTP/1.1")[0]


def test_warc_is_the_same_whatever_the_partitions(spark, tmp_path):
    given = [(i, f"http://h{i % 3}/{i}", f"text {i % 50} " * 40 + ("own" * i if i % 4 else "")) for i in range(400)]
    one, first = archive(spark, tmp_path, pages(spark, given, 1), target=2000)
    two, second = archive(spark, tmp_path, pages(spark, given[::-1], 6), target=2000)
    assert first == second and len(first) > 10 and max(r["bytes"] for r in first) < 6000
    for r in first:
        data = [open(f"{x}/{r['name']}", "rb").read() for x in (one, two)]
        assert data[0] == data[1] and hashlib.sha256(data[0]).hexdigest() == r["sha256"] and len(data[0]) == r["bytes"]
    got = [(int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in warc.read_archives(spark, one, payloads=False).collect()]
    assert key(got) == key(plain_records(given))
    ids = [int(m) for r in first for m in re.findall(rb"\nX-Page-Id: (\d+)", gzip.decompress(open(f"{one}/{r['name']}", "rb").read()))]
    assert ids == sorted(ids)


def test_warc_of_nothing_and_of_no_manifest(spark, tmp_path):
    folder, manifest = archive(spark, tmp_path, pages(spark, PAGES).limit(0))
    assert manifest == [] and warc.read_archives(spark, folder).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        warc.read_archives(spark, str(tmp_path / "none")).count()


def test_warc_damage_is_found(spark, tmp_path):
    folder, manifest = archive(spark, tmp_path, pages(spark, PAGES))
    path = f"{folder}/{manifest[0]['name']}"
    whole = gzip.decompress(open(path, "rb").read()).replace(b"copy copy", b"copy c0py", 1)
    open(path, "wb").write(gzip.compress(whole))
    with pytest.raises(Exception, match="not whole"):
        warc.read_archives(spark, folder).count()


# 13


def plain_phrases(given, least=10, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in given:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * f[q] >= 50 * a for q in f if len(q) == 3 and f[q] >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return out


def corpus(spark, given):
    df = spark.createDataFrame([(l, t) for l, t in given], "lang string, text string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in [*CLASHING, "w1", "w2", "a", "l1", "l", "r", "score", "rank", "phrase", "range"]}).repartition(4)


def texts():
    rnd = random.Random(13)
    words = ["the", "The", "of", "new", "york", "city", "a\x01b", "a", "Ünï", "ünï", "漢字", " ", "x" * 300, "b!c", "it's"]
    given = [(rnd.choice(["en", "en", "de", None, "und", ""]), " ".join(rnd.choices(words, k=rnd.randrange(60)))) for _ in range(150)]
    given += [("en", "new york city new york, new\tyork.  city\nnew york city"), ("en", None), ("de", ""), (None, None), ("en", "The NEW york " * 20_000), ("fr", "one two"), ("a b", "w1 w2\x0bw3 w4 " * 20)]
    return given + [(x[2], x[1]) for x in EDGE]


@pytest.mark.parametrize("limits", [{}, {"SHARD_WORDS": 50, "MERGE_NODES": 20}])
def test_phrases(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    got = phrases.collocations(corpus(spark, texts()))
    expected = plain_phrases(texts())
    assert len(expected) > 100 and key(rows(got)) == key(expected)


def test_phrases_top_and_nothing(spark):
    got = phrases.collocations(corpus(spark, texts()), top=5)
    assert key(rows(got)) == key(plain_phrases(texts(), top=5))
    assert phrases.collocations(corpus(spark, texts()).limit(0)).count() == 0


def test_scores_are_exact(spark):
    big = [(10**15, 10**15, 10**15), (3 * 10**14 + 1, 10**15 - 3, 7 * 10**14 + 11), (10, 10, 999_999_999_999_999)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.cut_score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in big]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_warc", "op13_phrases"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, relation = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    assert key([r[c] for c in columns] for r in df.collect()) == key([r[i] for i in place] for r in relation.fetchall())
