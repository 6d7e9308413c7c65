"""Histories of snapshots: full build and idempotent append (J06, W02, W03, U01, U02, ST3-ST6)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import with_ranks
from tidemark.functions.schema import STOCK_NAMES
from tidemark.operators.snapshot import per_key_and_date
from tidemark.sources import commits, versions
from tidemark.sources.files import accepted, records, union

#: How often a change is made anew because another writer was faster.
ATTEMPTS = 20
#: Columns that order rows of one key and date, and are no part of a history.
PLACES = ("precedence", "age", "file_num", "line")


def enriched(snapshot: DataFrame, date: dt.date | None = None, commit_hash: str | None = None) -> DataFrame:
    """A snapshot with its date, commit and ranks."""
    fixed = {k: F.lit(v) for k, v in (("date", date), ("commit_hash", commit_hash)) if v is not None}
    return with_ranks(snapshot.withColumns(fixed))


def build(snapshots: list[DataFrame], key: str) -> DataFrame:
    """All snapshots, one row per key and date (T20), ties by the explicit order of ``newest_first``."""
    return per_key_and_date(with_ranks(union(snapshots)), key).drop(*PLACES)


def high_water_mark(history: DataFrame) -> dt.date | None:
    """S06, ST3: the newest date of rows that are no versioned history (whose manifest knows it), whatever their order (T4)."""
    return history.agg(F.max("date")).first()[0]


def upserted(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New and old rows, of one key and date the new one."""
    both = new.withColumn("precedence", F.lit(0)).unionByName(old.withColumn("precedence", F.lit(1)), allowMissingColumns=True)
    return per_key_and_date(both, key).drop(*PLACES)


@dataclass(frozen=True)
class Appended:
    """ST6: what a build or append did: ``missing`` history, ``current`` (nothing newer), ``no file`` (newer commits, none
    with a readable file; a failure), ``built``, or ``appended`` so many rows from ``cutoff`` on."""

    state: str
    rows: int = 0
    cutoff: dt.date | None = None


def read_history(spark: SparkSession, path: str, **which) -> DataFrame | None:
    """The newest version of a history, or what of it ``versions.read`` is asked for; None if there is none."""
    return versions.read(spark, path, **which)


def replace_dates(spark: SparkSession, path: str, rows: DataFrame, key: str = "ticker") -> int:
    """ST5: puts ``rows``, whole dates, in the place of those dates, as one change; returns how many there are. What other writers change meanwhile stays."""
    rows = rows.persist()
    try:
        return _changed(spark, path, lambda _: rows, key)[1]
    finally:
        rows.unpersist()


def _changed(spark: SparkSession, path: str, make: Callable[[versions.Version | None], DataFrame | None], key: str) -> tuple[versions.Version | None, int]:
    """Commits what ``make`` gives for the newest version, again for a newer one if another writer was faster. The version, and the rows of the change."""
    for _ in range(ATTEMPTS):
        base = versions.version(spark, path)
        rows = make(base)
        if rows is None:
            return base, 0
        try:
            made = versions.commit(spark, path, base, rows, key)
        except versions.Conflict:
            continue
        before = base.dates if base else {}
        return made, sum(n for d, (c, n) in made.dates.items() if before.get(d, ("", None))[0] != c) if made else 0
    raise versions.Conflict(f"{path}: {ATTEMPTS} other changes came first")


def append(spark: SparkSession, path: str, new: DataFrame, key: str, lateness: int = 0) -> Appended:
    """ST3-ST5: rows of ``new`` after the history's newest date join it; dates that ``new`` touches are rewritten, as one change.

    ``lateness`` days before the newest date are taken too (T: the default, none, drops them silently, as a second
    snapshot of the newest day). Rows that meet an old key and date replace it. The newest date comes from the manifest, and of the history only
    the dates touched are read. Running the same append again changes nothing; one that meets another writer's change is made anew on top of it.
    """
    done = Appended("missing")

    def make(base: versions.Version | None) -> DataFrame | None:
        nonlocal done
        if base is None:
            return None
        cutoff = cutoff_of(base, lateness)
        fresh = with_ranks(new)
        fresh = fresh.where(F.col("date") > F.lit(cutoff)) if cutoff else fresh
        dates = [r[0] for r in fresh.select("date").distinct().collect()]  # one value a day
        done = Appended("appended" if dates else "current", cutoff=cutoff)
        return upserted(fresh, versions.read(spark, path, base, dates), key) if dates else None

    rows = _changed(spark, path, make, key)[1]
    return replace(done, rows=rows)


def cutoff_of(base: versions.Version, lateness: int) -> dt.date | None:
    """The day after which rows are new."""
    mark = base.newest()
    return mark - dt.timedelta(days=lateness) if mark else None


def from_index(found: DataFrame, repo: str, names: dict[str, str] = STOCK_NAMES, first_only: bool = False, program: str = "git") -> DataFrame:
    """Every record (see ``files.records``) of the files that ``commits.index`` or ``commits.stream`` has found, with the commit's date and hash; of
    each commit all files, or ``first_only`` the first with rows (S10). A blob is read and parsed once, whichever commits have it."""
    texts = commits.contents(found, repo, program)
    if first_only:
        fit = texts.where(commits.has_rows(F.col("content"))).select("blob")
        found = commits.first_available(found.join(fit, "blob"), F.lit(True))
    own = [c for c in found.columns if c != "blob"]
    rows = records(texts, names)
    return found.join(rows.drop(*own), "blob").drop("blob", "message")


def from_commits(spark: SparkSession, repo: str, files: list[str], names: dict[str, str] = STOCK_NAMES, after: dt.date | None = None, first_only: bool = False) -> DataFrame:
    """The rows of the given files of all commits (``after`` a day)."""
    return accepted(from_index(commits.index(spark, repo, files, after), repo, names, first_only)).drop("file")


def build_from_commits(spark: SparkSession, repo: str, path: str, files: list[str], key: str, names: dict[str, str] = STOCK_NAMES) -> Appended:
    """The whole history of a repository's snapshots, written to ``path`` as one change; dates that it had before and the repository lacks stay."""
    if not commits.log(repo):
        return Appended("current")
    rows = build([from_commits(spark, repo, files, names)], key).persist()
    try:
        return Appended("no file") if rows.isEmpty() else Appended("built", replace_dates(spark, path, rows, key))
    finally:
        rows.unpersist()


def append_from_commits(spark: SparkSession, repo: str, path: str, files: list[str], key: str, names: dict[str, str] = STOCK_NAMES, lateness: int = 0) -> Appended:
    """ST3-ST6: the commits after the history's newest date join it; only their files are fetched."""
    base = versions.version(spark, path)
    if base is None:
        return Appended("missing")
    cutoff = cutoff_of(base, lateness)
    if not commits.newer(repo, cutoff):
        return Appended("current", cutoff=cutoff)
    new = from_commits(spark, repo, files, names, cutoff).persist()
    try:
        return Appended("no file", cutoff=cutoff) if new.isEmpty() else append(spark, path, new, key, lateness)
    finally:
        new.unpersist()


def build_legacy(spark: SparkSession, repo: str, files: list[str], names: dict[str, str] = STOCK_NAMES) -> DataFrame:
    """The old history: of each commit the first file with rows, no row left out, oldest date first, then by commit and line."""
    rows = from_commits(spark, repo, files, names, first_only=True)
    return rows.orderBy("date", F.col("age").desc(), "line").drop("commit_hash", *PLACES)
