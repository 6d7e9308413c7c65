"""Snapshots kept in a git history, as a Spark data source for batches and streams (S01-S03, S10, S11, S13, ST1)."""

from __future__ import annotations

import datetime as dt
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.columns import day
from tidemark.operators.numbering import lines
from tidemark.operators.snapshot import first_rows

Commit = tuple[str, dt.date, str]

#: Commits that one task looks up, and bytes of files that it sends on at once.
COMMITS_PER_TASK, BATCH_BYTES = 500, 4 << 20


def _git(repo: str, *args: str, program: str = "git") -> str | None:
    done = subprocess.run([program, "-C", repo, *args], capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else None


def _commits(repo: str, *which: str, program: str = "git") -> list[Commit]:
    found = _git(repo, "log", "--date=short", "--pretty=format:%H|%ad|%s", *which, program=program) or ""
    fields = (line.split("|", 2) for line in found.splitlines() if line.count("|") >= 2)
    return [(h, dt.date.fromisoformat(d), m) for h, d, m in fields]


def log(repo: str) -> list[Commit]:
    """(hash, date, message) of the commits of all refs, newest first; empty where there is no repository."""
    return _commits(repo, "--all")


def newer(repo: str, after: dt.date | None) -> list[Commit]:
    """The commits dated strictly after a day; all if it is None."""
    return [c for c in log(repo) if after is None or c[1] > after]


def heads(repo: str, program: str = "git") -> list[str]:
    """The commits that the repository's refs stand at, in order of their hashes."""
    found = _git(repo, "for-each-ref", "--format=%(if)%(*objectname)%(then)%(*objectname)%(else)%(objectname)%(end)", program=program) or ""
    return sorted({*found.split(), *(_git(repo, "rev-parse", "-q", "--verify", "HEAD", program=program) or "").split()})


def between(repo: str, old: list[str], new: list[str], program: str = "git") -> list[Commit]:
    """The commits that can be reached from ``new`` but not from ``old``, newest first; what is gone from the repository counts for neither."""
    return _commits(repo, "--ignore-missing", *new, "--not", *old, program=program) if new else []


class _Commits(InputPartition):
    def __init__(self, commits: list[tuple]) -> None:
        self.commits = commits


class _Index:
    """Rows of commits and files with the ids of the blobs, by one process a task."""

    def __init__(self, options: dict) -> None:
        self.repo, self.files, self.program = options["path"], options["files"].split(","), options.get("program") or "git"
        self.per_task = int(options.get("commitsPerTask", COMMITS_PER_TASK))
        self.after = dt.date.fromisoformat(options["after"]) if options.get("after") else None
        self.remote = options.get("fetch", "")

    def dealt(self, commits: list[Commit]) -> list[InputPartition]:
        rows = [(age, *c) for age, c in enumerate(c for c in commits if self.after is None or c[1] > self.after)]
        return [_Commits(rows[i : i + self.per_task]) for i in range(0, len(rows), self.per_task)] or [_Commits([])]

    def read(self, partition: _Commits) -> Iterator[tuple]:
        wanted = [(*c, name, number) for c in partition.commits for number, name in enumerate(self.files, 1)]
        asked = "".join(f"{w[1]}:{w[4]}\n" for w in wanted)
        said = subprocess.run([self.program, "-C", self.repo, "cat-file", "--batch-check=%(objectname) %(objecttype)"], input=asked, capture_output=True, text=True, check=True).stdout if wanted else ""
        for row, answer in zip(wanted, said.splitlines(), strict=True):
            if answer.endswith(" blob"):
                yield *row, answer.split()[0]


class _Reader(_Index, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.dealt(_commits(self.repo, "--all", program=self.program))


class _StreamReader(_Index, DataSourceStreamReader):
    """An offset is the commits that the refs stood at; what lies between two offsets is what the later ones reach and the earlier do not. So
    each commit is read once, on whatever branch and of whatever date, also after a restart from the checkpoint."""

    def initialOffset(self) -> dict:
        return {"heads": ""}

    def latestOffset(self) -> dict:
        if self.remote:
            _git(self.repo, "fetch", "-q", self.remote, program=self.program)
        return {"heads": ",".join(heads(self.repo, self.program))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = (x["heads"].split(",") if x["heads"] else [] for x in (start, end))
        return self.dealt(between(self.repo, old, new, self.program))

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the checkpoint."""


class SnapshotSource(DataSource):
    """Format ``snapshots``: a row for each commit and each of ``files`` that it has, with the id of the file's blob (S03); as a stream, the commits
    that are new. ``age`` counts from the newest commit of a batch.

    Commits are dealt to tasks ``commitsPerTask`` at a time; the repository's path must be one that they all reach. A stream with ``fetch``
    fetches from that remote whenever it looks for new commits.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "age int, commit_hash string, date date, message string, file string, file_num int, blob string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _options(files: list[str], after: dt.date | None, program: str) -> dict[str, str]:
    return {"files": ",".join(files), "after": after.isoformat() if after else "", "program": program}


def index(spark: SparkSession, repo: str, files: list[str], after: dt.date | None = None, program: str = "git") -> DataFrame:
    """Where the given files of every commit (``after`` a day: only of later ones) lie, with the blobs' ids; no content is read."""
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("snapshots").options(**_options(files, after, program)).load(repo)


def stream(spark: SparkSession, repo: str, files: list[str], fetch: str = "", program: str = "git") -> DataFrame:
    """ST1: the same as a stream of the commits that come."""
    spark.dataSource.register(SnapshotSource)
    return spark.readStream.format("snapshots").options(fetch=fetch, **_options(files, None, program)).load(repo)


def contents(found: DataFrame, repo: str, program: str = "git") -> DataFrame:
    """(blob, content) for the distinct blobs of ``found``: each is read once, whichever commits have it, by one process a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen([program, "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
            ids, texts, held = [], [], 0
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    process.stdin.write(f"{blob}\n".encode())
                    process.stdin.flush()
                    size = int(process.stdout.readline().split()[2])
                    ids.append(blob)
                    texts.append(process.stdout.read(size).decode("utf-8", "replace"))
                    process.stdout.read(1)
                    held += size
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["blob", "content"])
                        ids, texts, held = [], [], 0
            process.stdin.close()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["blob", "content"])

    return found.select("blob").distinct().mapInArrow(run, "blob string, content string")


def snapshots(spark: SparkSession, repo: str, files: list[str], after: dt.date | None = None, program: str = "git") -> DataFrame:
    """The given files of every commit with their content, missing ones left out."""
    found = index(spark, repo, files, after, program)
    return found.join(contents(found, repo, program), "blob").drop("blob")


def has_rows(content: Column) -> Column:
    """Whether a text has a line after its header."""
    return content.rlike(r"\n\s*\S")


def first_available(rows: DataFrame, usable: Column | None = None) -> DataFrame:
    """Of each commit the first file, by number, that is usable (by default: has a line after its header)."""
    fit = usable if usable is not None else has_rows(F.col("content"))
    return first_rows(rows.where(fit), ["commit_hash"], [F.col("file_num")])


def dated_lines(log: DataFrame) -> DataFrame:
    """(hash, date) from rows (n, line) of a log that has a hash on one line and its date on the next."""
    block = F.floor(F.col("n") / 2)
    return log.groupBy(block.alias("block")).agg(F.max(F.when(F.col("n") % 2 == 0, F.trim("line"))).alias("hash"), day(F.max(F.when(F.col("n") % 2 == 1, F.trim(F.col("line"))))).alias("date")).select("hash", "date")


def log_of_lines(spark: SparkSession, path: str) -> DataFrame:
    """(hash, date) from a file that holds such a log."""
    return dated_lines(lines(spark, path))


def upstream_ahead(repo: str, branch: str, remote: str = "origin") -> bool:
    """Whether the remote's branch has commits that the local one lacks, as far as it was fetched."""
    counts = _git(repo, "rev-list", "--left-right", "--count", f"{branch}...{remote}/{branch}")
    return bool(counts) and int(counts.split()[1]) > 0
