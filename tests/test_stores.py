"""The package source, arrivals, committed batches, the job store and expiring answers."""

import datetime as dt
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from packsift.catalog import signals as S
from packsift.functions.text import needles
from packsift.plans.streams import run_reputation_timeline
from packsift.sources import archives, commits, jobstore, reportstore, stored

FILES = [("a.js", b"x" * 5000), ("img/b.bin", bytes(range(256)) * 40), ("manifest.json", b"{}"), ("empty.txt", b"")]


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = archives.archive_bytes(FILES)
    (folder / "good.zip").write_bytes(good)
    (folder / "head.CRX").write_bytes(b"Cr24" + (3).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"head" + good)
    (folder / "noise.zip").write_bytes(b"no archive")
    (folder / "evil.zip").write_bytes(archives.archive_bytes([("../x", b"1"), ("y", b"2")]))
    (folder / "none.zip").write_bytes(archives.archive_bytes([]))
    (folder / "readme.txt").write_bytes(b"not a package")
    return folder


def rows(df):
    return sorted((r.name, r.path, bytes(r.content) if r.content is not None else None, r.reject) for r in df.collect())


EXPECTED = sorted([*[(n, p, c, None) for n in ("good", "head") for p, c in FILES], ("noise", None, None, "not a zip archive"), ("evil", "../x", None, "unsafe path")],
                  key=lambda r: (r[0], r[1] or ""))


@pytest.mark.parametrize("split", [64, 3000, 1 << 25])
def test_packages_are_read_by_range(spark, inbox, split):
    df = archives.read_archives(spark, str(inbox), splitBytes=split)
    assert sorted(rows(df), key=lambda r: (r[0], r[1] or "")) == EXPECTED
    digests = {r["name"]: r.directory_sha256 for r in df.filter("path = 'a.js'").collect()}
    assert digests["good"] == digests["head"] and len(digests["good"]) == 64


def test_ranges_cover_every_byte_once():
    files = [("a", 0), ("b", 10), ("c", 100), ("d", 35)]
    parts = [r for p in archives.ranges_of(files, 30) for r in p.ranges]
    for path, size in files:
        mine = sorted((a, b) for p, a, b in parts if p == path)
        assert mine[0][0] == 0 and mine[-1][1] > size and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))


def test_no_packages(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path / "nothing")).count() == 0


def test_arrivals_replay_the_same_files(inbox, tmp_path):
    reader = archives.ArrivalReader({"path": str(inbox), "log": str(tmp_path / "log")})
    assert reader.initialOffset() == {"entry": 0}
    first = reader.latestOffset()
    before = [p.ranges for p in reader.partitions({"entry": 0}, first)]
    (inbox / "later.zip").write_bytes(archives.archive_bytes([("z", b"z")]))
    again = archives.ArrivalReader({"path": str(inbox), "log": str(tmp_path / "log")})
    assert [p.ranges for p in again.partitions({"entry": 0}, first)] == before  # a batch that is run again
    second = again.latestOffset()
    new = [r[0].rsplit("/", 1)[-1] for p in again.partitions(first, second) for r in p.ranges]
    assert new == ["later.zip"] and again.latestOffset() == second and again.partitions(second, second)[0].ranges == []


def test_a_batch_is_committed_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert commits.committed(spark, folder, "n long").count() == 0
    assert commits.write_once(spark.range(3).toDF("n"), folder, 0)
    assert not commits.write_once(spark.range(9).toDF("n"), folder, 0)  # the batch again, after a crash behind its commit
    spark.range(50).toDF("n").write.parquet(commits.CommitLog(spark, folder).fresh())  # a write that never got to its commit
    assert commits.write_once(spark.range(2).toDF("n"), folder, 1)
    assert commits.committed(spark, folder, "n long").count() == 5
    log = commits.CommitLog(spark, folder)
    assert log.numbers() == [0, 1] and not log.commit(1, {"path": "x"}) and log.read(1)["path"].startswith("data/")


def events(spark, *rows):
    return spark.createDataFrame([(j, s, dt.datetime(2024, 1, 1, h), e) for j, s, h, e in rows], "job_id long, status string, updated_at timestamp, event_id long")


def test_job_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = jobstore.JobStore(spark, str(tmp_path / "jobs"), buckets=8)
    assert store.jobs().count() == 0 and store.upsert(events(spark)) == [] and store.job(1).count() == 0
    first = events(spark, *[(j, "queued", 1, j) for j in range(40)])
    assert len(store.upsert(first)) == 8
    before = store._state()[1]
    touched = store.upsert(events(spark, (7, "done", 3, 100), (7, "running", 2, 99)))
    after = store._state()[1]
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == {str(touched[0])}
    row = store.job(7).collect()
    assert [(r.status, r.n_events, r.created_at.hour, r.updated_at.hour) for r in row] == [("done", 3, 1, 3)]
    assert all(f"bucket={touched[0]}/" in f for f in store.job(7).inputFiles()) and store.jobs().count() == 40
    store.upsert(events(spark, (7, "late", 2, 101)))  # an older event does not win
    assert store.job(7).first().status == "done"
    whole = stored.latest_status(first.unionByName(events(spark, (7, "done", 3, 100), (7, "running", 2, 99), (7, "late", 2, 101))))
    assert {(r.job_id, r.status, r.n_events) for r in whole.collect()} == {(r.job_id, r.status, r.n_events) for r in store.jobs().collect()}


def test_reports_are_read_from_their_commit(spark, tmp_path):
    store = reportstore.ReportStore(spark, str(tmp_path / "reports"))
    assert store.read().count() == 0
    rows = [("e1", "verdict", 1, "safe", "low"), ("e1", "finding", 1, "k", "bad\x00text"), ("e1", "finding", 2, "k", None), ("e2", "verdict", 1, "malicious", "high")]
    make = lambda r: spark.createDataFrame(r, reportstore.SCHEMA)
    first = store.write(make(rows))
    assert sorted((r.ext_id, r.section, r.seq, r.text) for r in store.read().collect()) == [
        ("e1", "finding", 1, "badtext"), ("e1", "finding", 2, None), ("e1", "verdict", 1, "low"), ("e2", "verdict", 1, "high")]
    assert all("section=verdict" in f for f in store.read("verdict").inputFiles()) and store.read("verdict").count() == 2
    second = store.write(make(rows[:1]))
    assert store.read().count() == 1 and store.read(number=first).count() == 4 and second == first + 1
    folder = tmp_path / "reports" / store.log.read(second)["path"] / "section=verdict"
    for file in folder.glob("part-*"):
        file.rename(tmp_path / file.name)  # a part that is lost
    with pytest.raises(ValueError, match="its commit says"):
        store.read("verdict")


def test_answers_are_renewed_and_expire(spark):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    rows = [("d", "p", 0), ("d", "p", 5), ("d", "p", 15), ("d", "q", 3), ("e", "p", 40), ("d", "p", 100)]
    df = spark.createDataFrame([(d, p, at(m)) for d, p, m in rows], "domain string, provider string, queried_at timestamp")
    got = {(r.domain, r.provider, r.kind, round((r.at - at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000) / 60000)) for r in run_reputation_timeline(spark, df, 600, "1 minute").collect()}
    assert got == {("d", "p", "stored", 0), ("d", "p", "renewed", 5), ("d", "p", "expired", 15), ("d", "p", "stored", 15), ("d", "p", "expired", 25), ("d", "p", "stored", 100),
                   ("d", "q", "stored", 3), ("d", "q", "expired", 13), ("e", "p", "stored", 40), ("e", "p", "expired", 50)}


def test_needles_are_in_every_match():
    """Each signal on a text made to match it, and the rules of the search for needles."""
    assert needles(r"\bfetch\s*=\s*(?:async\s+)?function") == ["function"] and needles(r"(?i)aBc?|de[fg]+hij") == ["ab", "hij"]
    assert needles(r"\b(?:one|two\.x)\b") == ["one", "two.x"] and needles(r"[ab]+\d") is None and needles(r"x{3,}yy(z|w)?") == ["yy"]
    texts = ["XMLHttpRequest.prototype.open =", "fetch = async function", 'apiSecret: "abcdefgh1"', "'G-ABCDEFGH1'", "panelistid PANALYTICSID", "tab?.url", "www.FaceBook.com",
             "adUnitId", "chrome.cookies.getAll (", "history.pushState =", 'document.createElement( "script" )', "new  Function (", "geosurf.io"]
    seen = 0
    for text in texts:
        for _, _, pattern, _ in S.GREP_SIGNALS:
            if re.search(pattern, text):
                seen += 1
                assert any(n in (text.lower() if pattern.startswith("(?i)") else text) for n in needles(pattern)), (text, pattern)
    assert seen >= len(texts)


def test_archives_are_built_from_tables(spark, tmp_path):
    files = spark.createDataFrame([("e1", "b.js", "B"), ("e1", "a.js", None), ("e2", "c", "ü")], "ext_id string, path string, text string")
    out = archives.write_archives(files, str(tmp_path / "out")).orderBy("ext_id").collect()
    assert [r.ext_id for r in out] == ["e1", "e2"]
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out" / "e1.zip").read_bytes())) as archive:
        assert archive.namelist() == ["a.js", "b.js"] and archive.read("a.js") == b""
    got = archives.read_archives(spark, str(tmp_path / "out")).select("name", "path", F.octet_length("content").alias("n")).collect()
    assert {tuple(r) for r in got} == {("e1", "a.js", 0), ("e1", "b.js", 1), ("e2", "c", 2)}
