"""Streams of commits and of CSV files, and what they reject."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_engine import Repo, rows

from tidemark.plans import history
from tidemark.sources import commits, files
from tidemark.streaming import append as stream

D = dt.date
FILES = ["s1.csv", "s2.csv"]


def shown(spark, path):
    return sorted(map(repr, rows(history.read_history(spark, path).select("date", "ticker", "price", "p1m", "r1m", "commit_hash"))))


@pytest.fixture
def program(tmp_path):
    """A git that writes down each process."""
    shim = tmp_path / "git-shim"
    shim.write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/processes\nexec git "$@"\n')
    shim.chmod(0o755)
    return str(shim)


def test_blobs_are_read_once_by_few_processes(spark, tmp_path, program):
    repo = Repo(tmp_path / "repo")
    for n in range(40):
        repo.commit(f"2024-01-{n // 2 + 1:02d}", f"c{n}", s1="Ticker\nA\n", s2=f"Ticker,Price\nB,{n // 10}\n")
    where = str(repo.folder)
    got = commits.snapshots(spark, where, [*FILES, "none.csv"], program=program).collect()
    said = (tmp_path / "processes").read_text().splitlines()
    assert len(got) == 80 and sum("--batch-check" in x for x in said) == 2 and sum(x.endswith("--batch") for x in said) <= 5
    # one task looks the blobs up, once for the distinct ones and once for the join
    direct = {(r["commit_hash"], r["file"]): commits._git(where, "show", f"{r['commit_hash']}:{r['file']}") for r in got}
    assert all(r["content"] == direct[r["commit_hash"], r["file"]] for r in got)
    assert commits.contents(commits.index(spark, where, FILES), where, program).count() == 5  # s1, and s2 in four versions
    assert {r["age"] for r in got} == set(range(40))


def test_awkward_blobs(spark, tmp_path):
    """Empty files, names of folders, bytes that are no text."""
    repo = Repo(tmp_path / "repo")
    (repo.folder / "s2.csv").mkdir()
    (repo.folder / "s2.csv" / "x").write_text("x")
    (repo.folder / "s3.csv").write_bytes(b"Ticker\n\xff\xfe\n")
    repo.commit("2024-01-01", "one", s1="")
    got = {r["file"]: r["content"] for r in commits.snapshots(spark, str(repo.folder), ["s1.csv", "s2.csv", "s3.csv"]).collect()}
    assert got == {"s1.csv": "", "s3.csv": "Ticker\n��\n"}


def test_stream_of_commits_reads_each_once(spark, tmp_path):
    repo = Repo(tmp_path / "repo").commit("2024-01-02", "one", s1="Ticker\nA\n").commit("2024-01-03", "two", s1="Ticker\nB\n")
    where, seen = str(repo.folder), []

    def take():
        source = commits.stream(spark, where, FILES)
        query = source.writeStream.foreachBatch(lambda df, n: seen.append(sorted(rows(df.select("message", "file"))))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        found, seen[:] = [x for x in seen if x], []
        return found

    assert take() == [[("one", "s1.csv"), ("two", "s1.csv")]]
    assert take() == []
    repo.commit("2024-01-04", "three", s2="Ticker\nC\n")  # s1 stays as it was
    assert take() == [[("three", "s1.csv"), ("three", "s2.csv")]]
    repo.git("checkout", "-q", "-b", "other", "HEAD~2")
    repo.commit("2023-12-31", "old day, other branch", s1="Ticker\nZ\n")
    repo.git("checkout", "-q", "-")
    repo.commit("2024-01-05", "five", s1="Ticker\nE\n")
    assert take() == [[("five", "s1.csv"), ("five", "s2.csv"), ("old day, other branch", "s1.csv")]]
    repo.git("branch", "same")
    repo.git("tag", "-a", "-m", "t", "mark")
    assert take() == []


def test_stream_of_a_remote(spark, tmp_path):
    """ST1, S13: a poll that fetches sees what the remote got."""
    far = Repo(tmp_path / "far").commit("2024-01-01", "one", s1="Ticker\nA\n")
    far.git("clone", "-q", str(far.folder), str(tmp_path / "near"))
    far.commit("2024-01-02", "two", s1="Ticker\nB\n")
    path, where = f"{tmp_path}/history", str(tmp_path / "near")
    for fetch, days in (("", [1]), ("origin", [1, 2])):
        stream.run_commits(commits.stream(spark, where, FILES, fetch), where, path, f"{tmp_path}/checkpoint", "ticker").awaitTermination()
        assert sorted({r["date"].day for r in history.read_history(spark, path).collect()}) == days


def test_history_of_a_commit_stream(spark, tmp_path):
    """Polls between commits give the history that one build gives; what cannot be read is kept with its place."""
    repo = Repo(tmp_path / "repo")
    where, path, rejects = str(repo.folder), f"{tmp_path}/history", f"{tmp_path}/rejects"

    def poll():
        stream.run_commits(commits.stream(spark, where, FILES), where, path, f"{tmp_path}/checkpoint", "ticker", rejects=rejects).awaitTermination()

    repo.commit("2024-01-02", "one", s1="Ticker,1M_RS_Percentile\nA,99\nA,98\n", s2="Ticker,Price\nA,7\nB,8\n")
    poll()
    poll()
    repo.commit("2024-01-03", "early", s1='Ticker,Price\nA,1\n"C,3\nD,4\n').commit("2024-01-03", "late", s1="Ticker,Price\nA,2\n").commit("2024-01-04", "bad", s1="", s2="x,y\n1,2\n")
    poll()
    history.build_from_commits(spark, where, f"{tmp_path}/whole", FILES, "ticker")
    assert shown(spark, path) == shown(spark, f"{tmp_path}/whole")
    got = rows(spark.read.parquet(rejects).select("date", "file", "line", "reason", "record"))
    assert sorted(got) == [(D(2024, 1, 3), "s1.csv", 2, "stray quote", '"C,3'), (D(2024, 1, 4), "s1.csv", 0, "no text", ""), (D(2024, 1, 4), "s2.csv", 0, "no known column", "x,y")]


def test_stream_of_drifting_csv(spark, tmp_path):
    """Files of two headers in one trigger give the history of ``read_all`` and ``build``; a later file joins by the same checkpoint."""
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "rs_1.csv").write_text('Ticker,Relative Strength,Price,date\nNA,1.5,2,2024-01-01\n"A,B",2,,2024-01-01\nC,5,1,2024-01-02\n')
    (landing / "rs_2.csv").write_text("date,Price,Ticker,1M_RS_Percentile,Relative Strength\n2024-01-02,9,Q,7,4\n2024-01-02,8,C,99,6\n")
    path, rejects = f"{tmp_path}/history", f"{tmp_path}/rejects"

    def take():
        stream.run_csv(stream.landed_csv(spark, str(landing)), path, f"{tmp_path}/checkpoint", "ticker", rejects=rejects).awaitTermination()

    def same(pattern):
        batch = history.build([files.read_all(spark, f"{landing}/{pattern}")[0]], "ticker")
        columns = [c for c in batch.columns if c in history.read_history(spark, path).columns]
        assert {"date", "ticker", "rs", "price", "p1m", "r1m", "source_file"} <= set(columns)
        assert sorted(map(repr, rows(history.read_history(spark, path).select(columns)))) == sorted(map(repr, rows(batch.select(columns))))

    take()
    same("rs_[12].csv")
    take()
    (landing / "rs_3.csv").write_text("Ticker,date,Sector\nC,2024-01-03,Oil\n")
    (landing / "rs_4.csv").write_text('Ticker,date\nD,2024-01-03\nE"x,2024-01-03\nF,2024-01-03\n')
    (landing / "rs_5.csv").write_text("")
    take()
    got = rows(spark.read.parquet(rejects).select("source_file", "line", "reason", "record"))
    assert got == [("rs_4.csv", 2, "stray quote", 'E"x,2024-01-03')] or sorted(got) == [("rs_4.csv", 2, "stray quote", 'E"x,2024-01-03'), ("rs_5.csv", 0, "no text", "")]
    assert sorted(rows(history.read_history(spark, path).where("date = DATE '2024-01-03'").select("ticker", "sector"))) == [("C", "Oil"), ("D", None), ("F", None)]


def test_dates_of_landed_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for n in (1, 2):
        (landing / f"rs_2024-01-0{n}.csv").write_text(f"Ticker,Price\nA,{n}\n")
    date = F.regexp_extract(F.col("source_file"), r"(\d{4}-\d\d-\d\d)", 1).cast("date")
    found = stream.landed_csv(spark, str(landing), date)
    stream.run_csv(found, f"{tmp_path}/history", f"{tmp_path}/checkpoint", "ticker").awaitTermination()
    assert sorted(rows(history.read_history(spark, f"{tmp_path}/history").select("date", "price"))) == [(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 2.0)]


def test_records_and_rejects_are_all_records(spark):
    texts = [
        ("a", 'Ticker,Price\nA,1\n"B,2\nC,3\nD"x,4\n"E ""x""",5\n"F"y,6\n"two\nlines",7\n'), ("b", "Ticker\n\n \nA\n"), ("c", ""), ("d", None), ("e", "x,y\n1,2\n3,4"), ("f", '"Ticker\nA\n'), ("g", "Ticker"), ("h", 'Ticker,Sector\r\n"q",""\r\n"",x\r\n'),
    ]
    found = files.records(spark.createDataFrame(texts, "name string, content string")).persist()
    good = sorted(map(str, rows(files.accepted(found).select("name", "line", "ticker", "price", "sector"))))
    assert good == sorted(map(str, [("a", 1, "A", 1.0, None), ("a", 3, "C", 3.0, None), ("a", 5, 'E "x"', 5.0, None), ("a", 7, "two\nlines", 7.0, None), ("b", 1, "A", None, None), ("h", 1, "q", None, None), ("h", 2, None, None, "x")]))
    bad = sorted(rows(files.rejected(found, "name")))
    assert bad == sorted([("a", 2, "stray quote", '"B,2'), ("a", 4, "stray quote", 'D"x,4'), ("a", 6, "stray quote", '"F"y,6'), ("c", 0, "no text", ""), ("d", 0, "no text", ""), ("e", 0, "no known column", "x,y"), ("f", 0, "no known column", '"Ticker')])
    assert found.count() == len(good) + len(bad)
