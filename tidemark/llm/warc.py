"""Deterministic sharded WARC archives (operator 12)."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut, tasks
from tidemark.llm.scans import scan
from tidemark.llm.texts import bounded, slices

#: Compressed bytes at which a file ends, and payload bytes from which a repeated payload is a revisit.
TARGET, LEAST = 64 << 20, 100
#: What a record without a large payload counts for when files are cut (its compressed size, about).
SMALL = 500
#: The date of records of which none is known, so that archives do not depend on the day they are made.
DATE = "2000-01-01T00:00:00Z"
#: Rows are in this order: by id (null last), URL, digest, and for rows equal in these by number.
KEY = ["no_id", "id", "url", "digest", "copy"]
CHUNK = 1 << 20

# The profile of revisits to an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(ident: str | None, url: str | None, digest: str, copy: int) -> str:
    """A record's identifier, of nothing but what the record holds."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((ident, url, digest, copy)))}>"


def member(fields: list[tuple[str, str | None]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own: header fields (those that are not None), digest and length of the block, the block."""
    lines = [f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))] if v is not None]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_member(kind: str, ident: str | None, url: str | None, digest: str, size: int, copy: int, payload: bytes | None, date: str, refers: tuple = ()) -> bytes:
    """The record of a page: a response with its payload, or a revisit that keeps the response's header only."""
    own = record_id(ident, url, digest, copy)
    uri = lambda i, u: quote(u, safe="!#$%&'()*+,-./:;=?@[]_~") if u else f"urn:x-page:{quote(i or 'none', safe='')}"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri(ident, url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", ident)]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers, digest, 0)), ("WARC-Refers-To-Target-URI", uri(*refers)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", refers[0])]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return member([*fields, ("Content-Type", "application/http;msgtype=response")], head + (payload or b""))


def _records(pages: DataFrame, date: str, bodies: bool) -> DataFrame:
    """Rows (id, ident, url, digest, size, weight, plain, body): a payload below LEAST bytes as it is, of a larger one the compressed response (if ``bodies``)
    and its size (neither where a batch has an equal payload of a lesser key, so the row cannot be the response)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            ids, idents, urls = (batch.column(c).to_pylist() for c in ("id", "ident", "url"))
            payloads = [x.encode("utf-8", "surrogatepass") for x in batch.column("html").to_pylist()]
            digests = [hashlib.sha256(x).hexdigest() for x in payloads]
            least: dict[str, tuple] = {}
            for n, d in enumerate(digests):
                key = (ids[n] is None, 0 if ids[n] is None else ids[n], urls[n] is not None, urls[n] or "", n)
                least[d] = min(least.get(d, key), key)
            plain = [p if len(p) < LEAST else None for p in payloads]
            packed = [page_member("response", idents[n], urls[n], d, len(p), 0, p, date) if len(p) >= LEAST and least[d][-1] == n else None for n, (p, d) in enumerate(zip(payloads, digests, strict=True))]
            columns = [pa.array(digests, pa.string()), pa.array([len(x) for x in payloads], pa.int64()), pa.array([len(x or b"") or SMALL for x in packed], pa.int64()), pa.array(plain, pa.binary()), pa.array(packed if bodies else [None] * len(packed), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ident"), batch.column("url"), *columns], ["id", "ident", "url", "digest", "size", "weight", "plain", "body"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(run, f"id {kind}, ident string, url string, digest string, size bigint, weight bigint, plain binary, body binary")


def _planned(records: DataFrame, target: int) -> DataFrame:
    """Rows (KEY, ident, size, plain, kind, refers_to, refers_url, file): what each row becomes and where. Only narrow rows move.

    Equal large payloads are one key of a scan by digest, whose first row is the response; a scan over all rows in their order numbers equal
    rows and sums the sizes above each, which the target cuts into files, the same ones whatever the cluster.
    """
    names = ["no_id", "id", "ident", "url", "digest", "size", "plain"]
    rows = records.withColumn("no_id", F.col("id").isNull()).select(*names, "weight")
    large = scan(rows.where(F.col("size") >= LEAST), ["digest"], ["no_id", "id", "url"], firsts=["ident", "url"])
    first, none = F.col("place") == 0, F.lit(None).cast("string")
    large = large.select(
        *names, F.when(first, F.col("weight")).otherwise(SMALL).cast("bigint").alias("weight"), F.col("place").alias("nth"), F.when(first, "response").otherwise("revisit").alias("kind"),
        F.when(~first, F.col("first_ident")).alias("refers_to"), F.when(~first, F.col("first_url")).alias("refers_url"),
    )
    little = rows.where(F.col("size") < LEAST).select(*names, "weight", F.lit(0).cast("bigint").alias("nth"), F.lit("response").alias("kind"), none.alias("refers_to"), none.alias("refers_url"))
    ordered = scan(large.union(little), KEY[:-1], ["nth"], totals=["weight"])
    return ordered.select(*names, F.col("place").alias("copy"), "kind", "refers_to", "refers_url", F.floor(F.col("above_weight") / target).cast("int").alias("file"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", target: int = TARGET, date: str = DATE) -> DataFrame:
    """Writes a record for each row of ``pages`` to files ``part-NNNNNNN.warc.gz`` in the new folder ``folder`` and returns their manifest:
    name, records, bytes, sha256.

    Rows are in order of id (null last), URL and payload digest, and a file ends where the compressed size above a record passes a multiple of ``target``,
    so the same rows give the same bytes, whatever the cluster. Of equal payloads of LEAST bytes or more the first is the response and the others
    revisits that refer to it. Payloads are compressed for their size, then again
    to be shuffled, once, to the task that writes their file; all else is decided on narrow rows. (To keep them between would cost as much disk as the archive.) Every attempt of a task writes under a name of its own; files get their names when all are there,
    and are an archive only once the manifest stands beside them. A lost executor costs a repeated task, and what failed leaves no archive.

    Null html is an empty payload; null ids and URLs have no field of their own; rows equal in all are a record each; other columns
    are ignored; very long pages are read whole; an empty table gives an archive of no files. The folder must be in a store that pyarrow reaches from all tasks.
    """
    spark, given = pages.sparkSession, F.col(f"`{id_col}`")
    narrow = bounded(pages).select(given.alias("id"), given.cast("string").alias("ident"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    plan = _planned(cut(_records(narrow, date, False).drop("body")), target)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/_temporary/files", recursive=True)
    first = plan.groupBy("file").agg(F.min(F.struct(*KEY)).alias("least")).orderBy("file").collect()  # a row a file
    sortable = lambda no_id, i, u, d, c: (no_id, 0 if i is None else i, u is not None, u or "", d, c)
    starts, files = [sortable(*r["least"]) for r in first], [r["file"] for r in first]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sortable(i is None, i, u, d, 0) for i, u, d in zip(*[batch.column(k).to_pylist() for k in ("id", "url", "digest")], strict=True)]
            at = [files[max(bisect_right(starts, k) - 1, 0)] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "file"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now, out, wanted = None, None, None

        def done() -> pa.RecordBatch:
            out["stream"].close()
            return pa.RecordBatch.from_pylist([{"name": f"part-{now:07d}.warc.gz", "temporary": out["name"], "records": out["records"], "bytes": out["bytes"], "sha256": out["sha"].hexdigest()}])

        def put(data: bytes) -> None:
            out["stream"].write(data)
            out["sha"].update(data)
            out["bytes"] += len(data)
            out["records"] += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != now:
                    if out:
                        yield done()
                    now = r["file"]
                    name = f"part-{now:07d}-{uuid.uuid4().hex}"
                    out = {"name": name, "stream": store.open_output_stream(f"{root}/_temporary/files/{name}", compression=None), "sha": hashlib.sha256(), "bytes": 0, "records": -1}
                    info = "software: tidemark\r\nformat: WARC File Format 1.1\r\n".encode()
                    put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, None, "warcinfo", now)), ("WARC-Date", date), ("WARC-Filename", f"part-{now:07d}.warc.gz"), ("Content-Type", "application/warc-fields")], info))
                key = (r["ident"], r["url"], r["digest"])
                if r["kind"] is None:  # a stored body
                    if wanted == key:
                        put(r["body"])
                        wanted = None
                    continue
                if wanted:
                    raise ValueError(f"no payload of record {wanted}")
                if r["kind"] == "response" and r["size"] >= LEAST:
                    wanted = key
                else:
                    put(page_member(r["kind"], *key, r["size"], r["copy"], r["plain"], date, (r["refers_to"], r["refers_url"]) if r["kind"] == "revisit" else ()))
        if wanted:
            raise ValueError(f"no payload of record {wanted}")
        if out:
            yield done()

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                source, to = f"{root}/_temporary/files/{r['temporary']}", f"{root}/{r['name']}"
                if store.get_file_info(source).type != fs.FileType.NotFound:  # else an attempt before this one has moved it
                    store.move(source, to)
            yield batch.drop_columns(["temporary"])

    bodies = _records(narrow, date, True).where("body IS NOT NULL").select("id", "ident", "url", "digest", "body").mapInArrow(place, f"id {narrow.schema['id'].dataType.simpleString()}, ident string, url string, digest string, body binary, file int")
    bodies = bodies.withColumns({"no_id": F.col("id").isNull(), "copy": F.lit(0).cast("bigint"), "tag": F.lit(1)})
    whole = plan.withColumns({"body": F.lit(None).cast("binary"), "tag": F.lit(0)}).unionByName(bodies, allowMissingColumns=True)
    wide = max(1, min(len(files), tasks(spark)))
    dealt = whole.repartitionById(wide, F.col("file") % wide).sortWithinPartitions("file", *KEY, "tag")
    written = cut(dealt.select("file", "no_id", "ident", "url", "digest", "copy", "size", "kind", "plain", "refers_to", "refers_url", "body").mapInArrow(write, "name string, temporary string, records bigint, bytes bigint, sha256 string"))
    manifest = written.mapInArrow(rename, "name string, records bigint, bytes bigint, sha256 string")
    manifest.write.mode("overwrite").json(f"{folder}/_temporary/manifest")
    _move(spark, f"{folder}/_temporary/manifest", f"{folder}/_manifest")
    _delete(spark, f"{folder}/_temporary")
    return spark.read.schema("name string, records bigint, bytes bigint, sha256 string").json(f"{folder}/_manifest")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The pages of the archive that ``write_archives`` has committed to ``folder``, read from its files: page_id (string), target_uri, record_type, payload_bytes and
    payload_digest (of the whole payload, also where a revisit leaves it out), refers_to (the page_id of a revisit's response), and payload unless not asked for.

    Files are read as streams, record by record. Digests of blocks and payloads are computed anew; one that does not fit its header is an error, as are records
    that the manifest does not have. A folder without a manifest is an error.
    """
    files = spark.read.schema("name string, records bigint, bytes bigint, sha256 string").json(f"{folder}/_manifest")

    def members(stream) -> Iterator[bytes]:
        opened, parts = zlib.decompressobj(31), []
        while data := stream.read(CHUNK):
            while data:
                parts.append(opened.decompress(data))
                data = opened.unused_data
                if opened.eof:
                    yield b"".join(parts)
                    opened, parts = zlib.decompressobj(31), []
        if any(parts):
            raise ValueError("a record ends too early")

    def parsed(record: bytes, name: str) -> tuple | None:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"{name}: the block of {fields['WARC-Record-ID']} is not whole")
        if fields["WARC-Type"] == "warcinfo":
            return None
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} is not whole")
        return fields.get("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, fields.get("X-Refers-To-Page-Id"), payload if payloads and fields["WARC-Type"] == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        for batch in batches:
            for file in batch.to_pylist():
                rows, held, seen = [], 0, -1
                with store.open_input_stream(f"{root}/{file['name']}", compression=None) as stream:
                    for record in members(stream):
                        seen += 1
                        row = parsed(record, file["name"])
                        if row:
                            rows.append(row)
                            held += len(row[-1] or b"")
                        if held > CHUNK or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)
                            rows, held = [], 0
                if seen != file["records"]:
                    raise ValueError(f"{file['name']}: {seen} records instead of {file['records']}")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)

    found = files.repartition(tasks(spark), "name").mapInArrow(run, "page_id string, target_uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
    return found if payloads else found.drop("payload")


NAMES = ["page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _move(spark: SparkSession, source: str, to: str) -> None:
    store, where = _path(spark, source)
    if not store.rename(where, _path(spark, to)[1]):
        raise OSError(f"{source} was not moved to {to}")


def _delete(spark: SparkSession, path: str) -> None:
    store, where = _path(spark, path)
    store.delete(where, True)
