"""The registered queries of this subpackage, ``opN_<name>``, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as exact
from tidemark.llm import chat, html_text, licenses, mixing, packing, phrases, quality, sharding, simhash, token_counts, trie, warc
from tidemark.llm.cluster import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(exact.normal(F.col("text")), 256))
    return exact.exact_dedup(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(added))
    chats = chat.format_chat(turns, chat.text_part(F.col("text")))
    read = chats.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: Escaping adds one character for each backslash and for each control string; the marks of a turn are 24 characters and its role.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<\|(im_start|im_end|image|audio|document|endoftext|startoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS body
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(body + length(role) + 24) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.encode(text, "utf-8")))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "n_chars": sharding.number_place(F.col("n_chars"))}
    out = sharding.kd_shards(docs, F.octet_length(text) + 1, dims, shards=16, carry=("text_crc32",), group=text)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "host", "n_blocks")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTERS, "base_failed", "char_distance", "word_distance", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.spliced(trie.turns_of(table(spark, sf_dir, "conversations"))))


#: CRC-32 bit by bit over the digits of c; nodes are told apart by the marks of their turns, and subtrees by the beginnings of these.
OP11_SQL = r"""
WITH o AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, mark) - 1 AS pos, mark, n FROM (
    SELECT conv_id AS c, turn, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS mark, length(text) AS n
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), h AS (
  SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM o)
), r AS (
  SELECT h.c, 0 AS source, o.pos, mark, n FROM h JOIN o ON o.c = h.b AND o.pos < h.h
  UNION ALL SELECT h.c, 1, o.pos, mark, n FROM h JOIN o ON o.c = h.c AND o.pos >= h.h
), t AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY source, pos) AS d, mark, n FROM r
), p AS (
  SELECT c, d, n, string_agg(mark, '') OVER (PARTITION BY c ORDER BY d) AS path FROM t UNION ALL SELECT c, 0, 0, '' FROM h
), e AS (
  SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM p
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, min(n) AS n, bool_and(ends) AS leaf, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM e GROUP BY path, d
), sums AS (
  SELECT a.path, count(*) FILTER (b.d = a.d + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves, CAST(sum((b.n_convs - 1) * b.n) AS BIGINT) AS saved_tokens
  FROM nodes a JOIN nodes b ON b.d >= a.d AND starts_with(b.path, a.path) GROUP BY a.path
)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, n_children, n_leaves, saved_tokens, sha256(x.ids) AS ends_sha256
FROM nodes x JOIN sums USING (path) LEFT JOIN nodes up ON x.d > 0 AND up.path = left(x.path, 64 * (x.d - 1))
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    read = warc.read_archives(spark, folder, payloads=False)
    return read.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


#: In order of page_id (null last) and URL, the first row of a large payload is the response.
OP12_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages
), r AS (
  SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first_id END AS refers_to FROM r
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: Counts of up to three words in a row, all in 128-bit integers.
OP13_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents)
), g AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
), f1 AS (
  SELECT lang, w[i] AS w1, count(*) AS f FROM g GROUP BY 1, 2
), f2 AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM g WHERE i + 1 <= len(w) GROUP BY 1, 2, 3
), f3 AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM g WHERE i + 2 <= len(w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10
), c2 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM f2 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE t.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 z WHERE z.lang = t.lang AND z.w1 = t.w1 AND z.w2 = t.w2 AND 2 * z.f >= t.f)
    AND NOT EXISTS (SELECT 1 FROM f3 z WHERE z.lang = t.lang AND z.w2 = t.w1 AND z.w3 = t.w2 AND 2 * z.f >= t.f)
), s3 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, a1.f AS l1, b1.f AS r1, a2.f AS l2, b2.f AS r2,
    CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(a1.f AS HUGEINT) * b1.f) AS s1, CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(a2.f AS HUGEINT) * b2.f) AS s2
  FROM f3 t JOIN f1 a1 ON a1.lang = t.lang AND a1.w1 = t.w1 JOIN f2 b1 ON b1.lang = t.lang AND b1.w1 = t.w2 AND b1.w2 = t.w3
    JOIN f2 a2 ON a2.lang = t.lang AND a2.w1 = t.w1 AND a2.w2 = t.w2 JOIN f1 b2 ON b2.lang = t.lang AND b2.w1 = t.w3
), s AS (
  SELECT lang, phrase, a, l, r, score FROM c2
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM s3
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s
)
SELECT k.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM k JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang) t ON t.lang = k.lang WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_sharding": op2_sharding,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_warc": op12_warc,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {"op1_chat_format": OP1_SQL, "op7_exact_dedup": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_phrases": OP13_SQL}
