"""DuckDB tables of the derived corpus as common table expressions.

``ctes`` maps a name to SQL; ``build`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import re

from packsift.catalog import categories as C
from packsift.catalog import domains as D
from packsift.catalog import findings as K
from packsift.catalog import patterns as P
from packsift.catalog import permissions as M
from packsift.catalog import signals as S
from packsift.plans import corpus as X


def q(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rows(values) -> str:
    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in values)


def m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def x(col: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({col}, {q(pattern)}, {group})"


def xall(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {q(pattern)}, {group})"


def sub(col: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(by)}, 'g')"


def hits(col: str, pattern: str) -> str:
    return f"len({xall(col, pattern)})"


def orlist(conditions) -> str:
    return "(" + " OR ".join(conditions) + ")"


def case(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


# --- URL and domain expressions ------------------------------------------------------


def host(col: str) -> str:
    return f"lower(nullif({x(col, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)')}, ''))"


def scheme(col: str) -> str:
    return f"lower(nullif({x(col, '^([a-zA-Z][a-zA-Z0-9+.-]*):')}, ''))"


def labels(col: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({col}, '.'), greatest(len(string_split({col}, '.')) - {n - 1}, 1), len(string_split({col}, '.'))), '.')"


def bare(col: str) -> str:
    return f"regexp_replace(lower({col}), '^www\\.', '')"


def registrable(col: str) -> str:
    d = bare(col)
    return (f"CASE WHEN len(string_split({d}, '.')) <= 2 THEN {d} WHEN {m(labels(d, 2), D.TWO_LABEL_SUFFIX)} "
            f"THEN {labels(d, 3)} ELSE {labels(d, 2)} END")


def under(h: str, names) -> str:
    return orlist(f"({h} = {q(n)} OR ends_with({h}, {q('.' + n)}))" for n in names)


def url_class(u: str) -> str:
    h, s = host(u), scheme(u)
    return case([
        (f"{u} = '<dynamic>'", "'dynamic'"), (f"{h} IS NULL OR {s} IS NULL", "'dynamic'"),
        (f"{h} IN {inlist(D.NAMESPACE_HOSTS)}", "'trusted'"), (under(h, D.TRUSTED_HOSTS), "'trusted'"),
        (under(h, D.ANALYTICS_HOSTS), "'analytics'"),
        (m(h, r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "'raw_ip'"),
        (f"{h} IN ('localhost', '127.0.0.1') OR ends_with({h}, '.local')", "'localhost'"),
        (f"{s} <> 'https'", "'non_https'"), (f"{labels(h, 1)} IN {inlist(D.BAD_TLDS)}", "'suspicious_tld'")], "'unknown'")


def url_points(c: str) -> str:
    return case([(f"{c} = {q(k)}", str(v)) for k, v in D.URL_POINTS.items()], "0")


def from_pattern(p: str) -> str:
    cleaned = f"regexp_replace({p}, '^\\*://', 'https://')"
    url = f"CASE WHEN contains({cleaned}, '://') THEN {cleaned} ELSE 'https://' || {cleaned} END"
    h = f"regexp_replace({host('(' + url + ')')}, '^\\*\\.', '')"
    return f"CASE WHEN NOT contains({h}, '*') AND NOT {m(h, '[' + chr(92) + 's<>|^]')} THEN nullif({h}, '') END"


def from_filter(p: str) -> str:
    anchored = f"lower(nullif({x(p, r'[|][|]([a-zA-Z0-9.-]+[.][a-zA-Z]{2,})')}, ''))"
    loose = f"lower(nullif({x(p, r'([a-zA-Z0-9-]+[.][a-zA-Z0-9-](?:[a-zA-Z0-9.-]*[a-zA-Z0-9-])?)')}, ''))"
    return f"CASE WHEN {p} <> '' THEN coalesce({from_pattern(p)}, {anchored}, {loose}) END"


def from_literal(t: str) -> str:
    by_url = f"lower(nullif({x(f'trim({t})', '(?i)^[a-z][a-z0-9+.-]*://([a-zA-Z0-9][-a-zA-Z0-9.]*)')}, ''))"
    loose = f"lower(nullif({x(f'trim({t})', r'^([a-zA-Z0-9][-a-zA-Z0-9]*[.][a-zA-Z0-9](?:[-a-zA-Z0-9.]*[-a-zA-Z0-9])?)(?:[/?#:]|$)')}, ''))"
    return (f"CASE WHEN {by_url} IS NOT NULL THEN CASE WHEN {by_url} NOT IN {inlist(D.LITERAL_NAMESPACES)} THEN {by_url} END "
            f"ELSE {loose} END")


def entity(col: str) -> str:
    return case([(m(bare(col), p), q(name)) for p, name, _ in D.ENTITY_PATTERNS], registrable(col))


def entity_category(col: str) -> str:
    return case([(m(bare(col), p), q(c)) for p, _, c in D.ENTITY_PATTERNS], "'unknown'")


def norm(col: str) -> str:
    return f"regexp_replace(lower({col}), '[^a-z0-9]', '', 'g')"


def alike(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


def own_domain(domain: str, name: str, author: str) -> str:
    parts = f"string_split({domain}, '.')"
    base = norm(f"(CASE WHEN len({parts}) >= 2 THEN {parts}[-2] ELSE {parts}[1] END)")
    maker = norm(f"regexp_split_to_array(coalesce({author}, ''), '\\s+')[1]")
    words = (f"list_filter(list_transform(regexp_split_to_array(lower(coalesce({name}, '')), '\\s+'), "
             f"lambda w: {norm('w')}), lambda w: len(w) > 3)")
    whole = norm(f"coalesce({name}, '')")
    return (f"(len({base}) >= 3 AND ((len({whole}) >= 3 AND {alike(whole, base)}) "
            f"OR len(list_filter({words}, lambda w: {alike('w', base)})) > 0 "
            f"OR (len({maker}) > 3 AND {alike(maker, base)})))")


def classified(source: str, keep: str) -> str:
    """SQL adding category and platform to (domain, name, author) rows of a source."""
    d = "s.domain"
    infra = f"(coalesce(k.category = 'infrastructure', FALSE) OR {orlist(f'ends_with(lower({d}), {q(e)})' for e in D.HOSTED_SUFFIXES)})"
    own = own_domain(bare(d), "s.name", "s.author")
    gov, proxy = m(bare(d), D.GOV_PATTERN), f"({bare(d)} IN {inlist(D.RESIDENTIAL_PROXIES)} OR {labels(bare(d), 2)} IN {inlist(D.RESIDENTIAL_PROXIES)})"
    return f"""
    SELECT {keep},
      CASE WHEN {infra} THEN 'infrastructure' WHEN {own} THEN 'own' WHEN k.category IS NOT NULL THEN k.category
           WHEN {gov} THEN 'government' WHEN {proxy} THEN 'data_broker' ELSE {entity_category(d)} END AS category,
      CASE WHEN {infra} OR {own} THEN NULL WHEN k.category IS NOT NULL OR {gov} OR {proxy} THEN k.platform
           ELSE {entity(d)} END AS platform
    FROM {source} s LEFT JOIN LATERAL (
      SELECT category, platform FROM c_known WHERE known IN (lower(s.domain), {bare('s.domain')}) ORDER BY rank, known = lower(s.domain) DESC LIMIT 1) k ON TRUE"""


def priority(c: str) -> str:
    return case([(f"{c} = {q(k)}", str(v)) for k, v in D.VISIT_PRIORITY.items()])


# --- text expressions --------------------------------------------------------------------


def obfuscated(col: str) -> str:
    return "(" + " + ".join(hits(col, p) for p in S.OBFUSCATION_INDICATORS) + f") > {S.OBFUSCATION_LIMIT}"


def entropy(col: str) -> str:
    return (f"(SELECT coalesce(-sum(f.n / f.total * log2(f.n / f.total)), 0) FROM (SELECT count(*)::DOUBLE AS n, "
            f"len({col})::DOUBLE AS total FROM (SELECT unnest(string_split({col}, '')) AS ch) WHERE ch <> '' GROUP BY ch) f)")


def minified(col: str) -> str:
    return (f"(len(list_filter(string_split({col}, chr(10)), lambda l: len(l) > {S.MAX_LINE})) > 0 "
            f"OR {hits(col, S.HEX_ESCAPE)} > {S.MAX_HEX_ESCAPES} "
            f"OR coalesce({hits(col, S.SHORT_ASSIGN)} / nullif({hits(col, S.LONG_WORD)}, 0) > {S.SHORT_LONG_RATIO}, FALSE) "
            f"OR (len({col}) > {S.ENTROPY_MIN_SAMPLE} AND {entropy(col)} > {S.ENTROPY_LIMIT}))")


def line_of(text: str, needle: str) -> str:
    return (f"CASE WHEN {needle} <> '' AND instr({text}, {needle}) > 0 "
            f"THEN len(string_split(substring({text}, 1, instr({text}, {needle}) - 1), chr(10))) ELSE 1 END")


def parent(col: str) -> str:
    return f"CASE WHEN contains({col}, '/') THEN {x(col, '^(.*)/[^/]*$')} ELSE '' END"


def resolve(folder: str, target: str) -> str:
    clean = f"replace(regexp_replace({target}, '\\?.*$', ''), chr(92), '/')"
    joined = f"CASE WHEN {folder} = '' THEN {clean} ELSE {folder} || '/' || {clean} END"
    parts = f"list_filter(string_split({joined}, '/'), lambda p: p <> '' AND p <> '.')"
    folded = (f"list_reduce({parts}, lambda a, p: CASE WHEN p = '..' AND a <> '' AND a <> '..' AND NOT ends_with(a, '/..') "
              f"THEN (CASE WHEN contains(a, '/') THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END) "
              f"WHEN a = '' THEN p ELSE a || '/' || p END, '')")
    return f"CASE WHEN starts_with({clean}, '/') THEN substring({clean}, 2) ELSE {folded} END"


def local(col: str) -> str:
    return f"(starts_with({col}, '.') OR starts_with({col}, '/') OR {m(col, S.LOCAL_FILE)})"


def resource_type(col: str) -> str:
    return case([(m(col, p), q(t)) for t, p in S.RESOURCE_TYPES], "'other'")


def suffixes(col: str, sep: str) -> str:
    p = f"string_split({col}, {q(sep)})"
    return f"list_transform(range(1, len({p}) + 1), lambda i: array_to_string({p}[i:], {q(sep)}))"


def b64(col: str) -> str:
    fit = f"(CASE WHEN len(replace({col}, '=', '')) % 4 = 1 THEN left(replace({col}, '=', ''), -1) ELSE replace({col}, '=', '') END)"
    return f"decode(from_base64(rpad({fit}, (ceil(len({fit}) / 4) * 4)::INT, '=')))"


def sink(col: str, names) -> str:
    return orlist([f"{col} IN {inlist(names)}", *[f"ends_with({col}, {q('.' + n)})" for n in names]])


def first_literal(col: str) -> str:
    quoted = x(col, "^\\s*(\"[^\"]*\"|'[^']*')")
    return f"CASE WHEN {quoted} <> '' THEN substring({quoted}, 2, len({quoted}) - 2) END"


def word(col: str, words) -> str:
    return case([(f"contains(lower({col}), {q(w)})", q(w)) for w in words])


def argument(args: str, i: str) -> str:
    part = f"trim(string_split({args}, ',')[{i} + 1])"
    return (f"CASE WHEN {m(part, ATOB)} THEN {x(part, '^atob[(][^)]*', 0)} "
            f"ELSE {sub(x(part, '^[^()]*', 0), TRIM)} END")


TRIM = r"^\s+|\s+$"
ATOB = r"^atob\(\s*[\"']([A-Za-z0-9+/]+={0,2})[\"']"
PIECE = r"\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[A-Za-z_$][A-Za-z0-9_$.]*"
COMMENT_TOKENS = (
    r"""(?s)"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"""
    r"""|/(?:[^*/\n\\]|\\.)(?:[^/\n\\]|\\.)*/[gimyus]*|/\*.*?\*/|//[^\n]*|[^"'`/]+|.""")


def source_label(t: str) -> str:
    return case([
        (f"{t} = 'document.cookie' OR starts_with({t}, 'document.cookie.')", "'document.cookie'"),
        (m(t, P.DOM_SELECTION), f"'DOM selection via ' || {t}"), (m(t, P.SENSITIVE_API), f"'sensitive API source ' || {t}"),
        (m(t, P.SENSITIVE_MEMBER), t), (m(t, P.DOM_READ), f"'DOM read ' || {t}")])


def tokens(e: str) -> str:
    return xall(e, r"[A-Za-z_$][A-Za-z0-9_$.]*")


def direct(e: str) -> str:
    return f"list_filter(list_transform({tokens(e)}, lambda t: {source_label('t')}), lambda s: s IS NOT NULL)[1]"


def roots(e: str) -> str:
    return f"list_distinct(list_transform({tokens(e)}, lambda t: string_split(t, '.')[1]))"


def band(c: str) -> str:
    return f"CASE WHEN {c} >= {K.BAND_FULL} THEN {c} WHEN {c} >= {K.BAND_HALF} THEN 0.5 ELSE 0.2 END"


def level(s: str, steps) -> str:
    return case([(f"{s} >= {n}", q(name)) for n, name in steps], "'low'")


# --- tables ---------------------------------------------------------------------------------

_T = len(X.MANIFEST_TEXTS)
CTES: dict[str, str] = {}

CTES["c_known"] = f"SELECT * FROM (VALUES {rows(D.DOMAIN_ROWS)}) t(known, category, platform, rank)"
CTES["c_perm"] = f"SELECT * FROM (VALUES {rows(M.PERMISSION_ROWS)}) t(permission, category, weight, host_sensitive)"
CTES["c_kind"] = f"SELECT * FROM (VALUES {rows(K.KIND_ROWS)}) t(kind, severity, category, confidence, impact, priority)"
CTES["c_scripts"] = f"""
SELECT 'ext-' || (doc_id // {X.FILES_PER_PACKAGE}) AS ext_id, {qlist(X.PATHS)}[doc_id % {X.FILES_PER_PACKAGE} + 1] AS path,
  {qlist(X.SNIPPETS)}[doc_id % {len(X.SNIPPETS)} + 1] || text AS raw FROM documents"""
CTES["c_packages"] = f"""
SELECT 'ext-' || n AS ext_id, n AS ext_no, coalesce(h, 'none.example.com') AS host, coalesce(c_name, 'Nobody') AS owner
FROM (SELECT DISTINCT doc_id // {X.FILES_PER_PACKAGE} AS n FROM documents) LEFT JOIN (SELECT page_id, {host('url')} AS h FROM pages) ON page_id = n
LEFT JOIN customer ON c_custkey = n"""


def filled(template: str) -> str:
    return f"replace(replace({template}, '@HOST@', host), '@NAME@', owner)"


CTES["c_mtext"] = f"SELECT ext_id, {filled(f'{qlist(X.MANIFEST_TEXTS)}[ext_no % {_T} + 1]')} AS text FROM c_packages"
CTES["c_extra"] = f"""
SELECT p.ext_id, e.path, {filled('e.text')} AS text FROM c_packages p JOIN (VALUES {rows(X.EXTRA_FILES)}) e(t, path, text)
  ON e.t = -1 OR e.t = p.ext_no % {_T}"""
CTES["c_all"] = """
SELECT ext_id, path, raw AS text, strlen(raw) AS size_bytes FROM c_scripts UNION ALL
SELECT ext_id, path, text, strlen(text) FROM c_extra UNION ALL
SELECT ext_id, 'manifest.json', text, strlen(text) FROM c_mtext"""
CTES["c_listing"] = f"SELECT ext_id, path FROM c_all WHERE NOT {m('path', S.SKIPPED_DIRS)}"
CTES["c_inventory"] = f"""
SELECT ext_id, path, {resource_type('path')} AS type, size_bytes::BIGINT AS size_bytes,
  CASE WHEN {resource_type('path')} IN ('javascript', 'css') AND len(text) > 0 THEN {minified('text')} ELSE FALSE END AS is_minified,
  CASE WHEN {resource_type('path')} IN ('javascript', 'html', 'json', 'css') AND len(text) > 0
       THEN len(string_split(text, chr(10))) ELSE 0 END::BIGINT AS line_count
FROM c_all WHERE NOT {m('path', S.SKIPPED_DIRS)}"""
_J = "json_extract_string(text, '$.{}')"


def _many(path: str) -> str:
    return f"coalesce(json_extract_string(text, '$.{path}'), [])"


CTES["c_mraw"] = f"""
SELECT ext_id, CASE WHEN {_J.format('manifest_version')} = '3' THEN 3 ELSE 2 END AS version,
  {_J.format('name')} AS raw_name, {_J.format('version')} AS ext_version,
  CASE WHEN json_type(text, '$.author') = 'OBJECT' THEN {_J.format('author.name')} ELSE {_J.format('author')} END AS author,
  coalesce({_J.format('default_locale')}, '') AS default_locale,
  list_filter({_many('permissions[*]')}, lambda p: NOT {m('p', M.HOST_PATTERN)}) AS api_perms,
  list_concat(CASE WHEN {_J.format('manifest_version')} = '3' THEN {_many('host_permissions[*]')} ELSE [] END,
    list_filter({_many('permissions[*]')}, lambda p: {m('p', M.HOST_PATTERN)})) AS host_perms,
  {_many('optional_permissions[*]')} AS optional_perms, {_many('content_scripts[*].matches[*]')} AS matches,
  {_many('content_scripts[*].js[*]')} AS content_js, {_many('content_scripts[*].css[*]')} AS content_css,
  coalesce(json_array_length(text, '$.content_scripts'), 0) AS n_content_scripts,
  list_has_any({_many('content_scripts[*].run_at')}, ['document_start', 'document_end']) AS auto_run,
  {_many('background.scripts[*]')} AS background, {_J.format('background.service_worker')} AS service_worker,
  coalesce({_J.format('action.default_popup')}, {_J.format('browser_action.default_popup')}, {_J.format('page_action.default_popup')}) AS popup,
  coalesce({_J.format('options_ui.page')}, {_J.format('options_page')}) AS options, {_J.format('devtools_page')} AS devtools,
  {_J.format('side_panel.default_path')} AS side_panel, {_many('sandbox.pages[*]')} AS sandbox,
  {_many('chrome_url_overrides.*')} AS overrides, {_many('declarative_net_request.rule_resources[*].path')} AS rule_files,
  text AS raw FROM c_mtext"""
CTES["c_messages"] = r"""
SELECT ext_id, regexp_extract(path, '^_locales/([^/]+)/', 1) AS locale, k AS key, json_extract_string(text, '$.' || k || '.message') AS message
FROM (SELECT *, unnest(json_keys(text)) AS k FROM c_extra WHERE regexp_matches(path, '^_locales/[^/]+/messages\.json$'))"""
CTES["c_manifests"] = """
SELECT r.* EXCLUDE (raw_name), CASE WHEN starts_with(raw_name, '__MSG_') THEN coalesce(
  (SELECT message FROM c_messages s WHERE s.ext_id = r.ext_id AND s.key = regexp_replace(regexp_replace(raw_name, '^__MSG_', ''), '__$', '')
   ORDER BY CASE WHEN locale = 'en' THEN 1 WHEN locale = r.default_locale THEN 2 ELSE 3 END, locale LIMIT 1),
  replace(regexp_replace(regexp_replace(raw_name, '^__MSG_', ''), '__$', ''), '_', ' ')) ELSE raw_name END AS name
FROM c_mraw r"""
_SLOTS = [("content_js", "content_script", True), ("background", "background", True), ("service_worker", "background", False),
          ("popup", "popup", False), ("options", "options_ui", False), ("devtools", "devtools", False),
          ("side_panel", "side_panel", False), ("sandbox", "sandbox", True), ("overrides", "override_page", True)]
CTES["c_refs"] = " UNION ALL ".join(
    f"SELECT ext_id, {i} AS slot, {q(role)} AS role, unnest({col if many else f'[{col}]'}) AS reference FROM c_manifests"
    for i, (col, role, many) in enumerate(_SLOTS))
CTES["c_pagescripts"] = f"""
SELECT ext_id, page, role, slot, src, CASE WHEN {m('src', '^https?://')} THEN NULL WHEN starts_with(src, '/') THEN substring(src, 2)
  WHEN {parent('page')} = '' THEN src ELSE {parent('page')} || '/' || src END AS path
FROM (SELECT r.ext_id, r.reference AS page, r.role, r.slot, unnest({xall('e.text', S.HTML_SCRIPT_JS, 1)}) AS src
  FROM c_refs r JOIN c_extra e ON e.ext_id = r.ext_id AND e.path = r.reference
  WHERE r.role IN ('popup', 'options_ui', 'devtools', 'side_panel', 'sandbox', 'override_page'))"""
CTES["c_slots"] = """
SELECT ext_id, reference, min(slot) AS slot, arg_max(role, slot) AS role FROM c_refs WHERE coalesce(reference, '') <> '' GROUP BY ALL
UNION ALL SELECT ext_id, path, min(slot) + 100, arg_min(role, slot) FROM c_pagescripts WHERE path IS NOT NULL GROUP BY ext_id, path"""
_BASE = "lower(string_split(path, '/')[-1])"
_LOW = "lower(path)"


def _has(*names):
    return orlist(f"contains({_LOW}, {q(n)})" for n in names)


CTES["c_roles0"] = f"""
SELECT s.ext_id, s.path, coalesce((SELECT arg_min(role, (slot, reference)) FROM c_slots t
    WHERE t.ext_id = s.ext_id AND (s.path = t.reference OR ends_with(s.path, '/' || t.reference))),
  {case([
    (orlist(f"starts_with({_BASE}, {q(lib)})" for lib in S.KNOWN_LIBRARIES), "'library'"),
    (f"contains({_LOW}, '/popup/') OR starts_with({_LOW}, 'popup/') OR {_LOW} = 'popup.js'", "'popup'"),
    (_has('options', 'settings'), "'options_ui'"), (_has('devtools', 'panel'), "'devtools'"), (_has('sandbox'), "'sandbox'"),
    (_has('background', 'service-worker', 'serviceworker'), "'background'"),
    (_has('/content', 'content-script', 'contentscript'), "'content_script'"), (m('path', S.INJECTOR_FILE), "'content_script'")], "'unknown'")}) AS role
FROM c_scripts s"""
_HEX = r"\"(?:\\x[0-9a-fA-F]{2}){3,}\"|'(?:\\x[0-9a-fA-F]{2}){3,}'"
_UNI = r"\"(?:\\u[0-9a-fA-F]{4}){3,}\"|'(?:\\u[0-9a-fA-F]{4}){3,}'"
_EVAL = r"eval\s*\(\s*(\"[^\"\n]*\"|'[^'\n]*')\s*\)"
CTES["c_decoded"] = f"""
SELECT ext_id, path, method, body, decoded FROM (
  SELECT ext_id, path, 'base64' AS method, body, CASE WHEN {m(b64('body'), S.PRINTABLE)} THEN {b64('body')} END AS decoded
    FROM (SELECT ext_id, path, unnest({xall('raw', S.BASE64_CALL, 1)}) AS body FROM c_scripts)
  UNION ALL SELECT ext_id, path, 'hex', body, decode(unhex({sub('body', r"\\x|[\"']")}))
    FROM (SELECT ext_id, path, unnest({xall('raw', _HEX)}) AS body FROM c_scripts)
  UNION ALL SELECT ext_id, path, 'unicode', body, array_to_string(list_transform(
      regexp_extract_all(body, '[0-9a-fA-F]{{4}}'), lambda h: chr(('0x' || h)::INT)), '')
    FROM (SELECT ext_id, path, unnest({xall('raw', _UNI)}) AS body FROM c_scripts)
  UNION ALL SELECT ext_id, path, 'char_codes', body, array_to_string(list_transform(list_filter(
      list_transform(string_split(body, ','), lambda c: try_cast(trim(c) AS INT)), lambda c: c >= 0 AND c < 65536), lambda c: chr(c)), '')
    FROM (SELECT ext_id, path, unnest({xall('raw', S.CHAR_CODES, 1)}) AS body FROM c_scripts)
  UNION ALL SELECT ext_id, path, 'eval_body', body, CASE WHEN NOT contains(body, 'eval')
      THEN substring(body, 2, len(body) - 2) END
    FROM (SELECT ext_id, path, unnest({xall('raw', _EVAL, 1)}) AS body FROM c_scripts))
WHERE decoded IS NOT NULL"""
# layers: every literal of a text that decodes is a text below it; depth 0 are the scripts themselves
_ESCAPED_EVAL = r"eval\s*\(\s*(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')\s*\)"
_LAYERS = [("base64", S.BASE64_CALL, 1), ("hex", _HEX, 0), ("unicode", _UNI, 0), ("char_codes", S.CHAR_CODES, 1), ("eval_body", _ESCAPED_EVAL, 1)]
_CODES = """array_to_string(list_transform(list_filter(list_transform(string_split(body, ','), lambda c: try_cast(trim(c) AS INT)),
  lambda c: c >= 0 AND c < 65536), lambda c: chr(c)), '')"""
_UNESCAPED = "replace(substring(body, 2, len(body) - 2), '\\\\', chr(1))"
for _escape, _plain in (("\\n", "chr(10)"), ("\\r", "chr(13)"), ("\\t", "chr(9)"), ('\\"', "chr(34)"), ("\\'", "chr(39)")):
    _UNESCAPED = f"replace({_UNESCAPED}, {q(_escape)}, {_plain})"
_UNESCAPED = f"replace({_UNESCAPED}, chr(1), '\\')"
_FOUND = ", ".join(f"{xall('text', p, 0)} AS m{k}, {xall('text', p, g)} AS b{k}, regexp_split_to_array(text, {q(p)}) AS g{k}" for k, (_, p, g) in enumerate(_LAYERS))
_SIZE = "coalesce(list_sum(list_transform({0}, lambda p: len(p))), 0)".format
_FEED = "coalesce(list_sum(list_transform({0}, lambda p: len(p) - len(replace(p, chr(10), '')))), 0)".format
_HITS = "list_concat(" + ", ".join(
    f"list_transform(range(1, len(b{k}) + 1), lambda i: {{'method': {q(name)}, 'number': i - 1, 'body': b{k}[i], 'spot': 1 + {_SIZE(f'g{k}[1:i]')} + {_SIZE(f'm{k}[1:i - 1]')}, "
    f"'feeds': 1 + {_FEED(f'g{k}[1:i]')} + {_FEED(f'm{k}[1:i - 1]')}}})" for k, (name, _, _) in enumerate(_LAYERS)) + ")"
CTES["r_layers"] = f"""
SELECT s.ext_id, s.path, '' AS layer, '' AS parent, 0 AS depth, '' AS method, 0::BIGINT AS spot, NULL::BIGINT AS line, '' AS decoded, raw AS text
FROM c_scripts s JOIN c_roles0 r ON r.ext_id = s.ext_id AND r.path = s.path WHERE r.role <> 'library'
UNION ALL
SELECT ext_id, path, CASE WHEN layer = '' THEN '' ELSE layer || '/' END || method || '.' || number, layer, depth + 1, method, spot, line, decoded,
  CASE WHEN method = 'eval_body' OR {m('decoded', '[(=;{]')} THEN decoded ELSE '"' || decoded || '"' END
FROM (SELECT ext_id, path, layer, depth, coalesce(line, hit.feeds)::BIGINT AS line, hit.method AS method, hit.number AS number, hit.spot::BIGINT AS spot,
    CASE hit.method WHEN 'base64' THEN CASE WHEN {m(b64('body'), S.PRINTABLE)} THEN {b64('body')} END
      WHEN 'hex' THEN decode(unhex({sub('body', r"\\x|[\"']")}))
      WHEN 'unicode' THEN array_to_string(list_transform(regexp_extract_all(body, '[0-9a-fA-F]{{4}}'), lambda h: chr(('0x' || h)::INT)), '')
      WHEN 'char_codes' THEN CASE WHEN {m(_CODES, S.PRINTABLE)} THEN {_CODES} END ELSE {_UNESCAPED} END AS decoded
  FROM (SELECT *, hit.body AS body FROM (SELECT ext_id, path, layer, depth, line, unnest({_HITS}) AS hit FROM (SELECT *, {_FOUND} FROM r_layers))))
WHERE decoded IS NOT NULL"""
_CLEAN = """array_to_string(list_transform({0}, lambda t: CASE WHEN starts_with(t, '/*') THEN regexp_replace(t, '[^\\n]+', '', 'g') WHEN starts_with(t, '//') THEN '' ELSE t END), '')"""
CTES["c_layers"] = f"SELECT *, {_CLEAN.format(xall('text', COMMENT_TOKENS))} AS code FROM r_layers WHERE depth > 0"


def hidden(pattern: str) -> str:
    return f"EXISTS (SELECT 1 FROM c_layers l WHERE l.ext_id = d.ext_id AND l.path = d.path AND {m('l.code', pattern)})"


CTES["c_described"] = f"""
SELECT ext_id, path, base_role, raw, is_obfuscated, is_minified, line_count, code,
  coalesce({m('code', S.USES_FETCH)}, FALSE) OR {hidden(S.USES_FETCH)} AS uses_fetch, coalesce({m('code', S.USES_XHR)}, FALSE) OR {hidden(S.USES_XHR)} AS uses_xhr,
  coalesce({m('code', S.USES_EVAL)}, FALSE) OR {hidden(S.USES_EVAL)} AS uses_eval, coalesce({m('code', S.USES_DOM_WRITE)}, FALSE) OR {hidden(S.USES_DOM_WRITE)} AS uses_dom_write
FROM (SELECT s.ext_id, s.path, r.role AS base_role, s.raw,
  r.role <> 'library' AND ({obfuscated('s.raw')} OR {minified('s.raw')})
    AND EXISTS (SELECT 1 FROM c_decoded d WHERE d.ext_id = s.ext_id AND d.path = s.path) AS is_obfuscated,
  r.role <> 'library' AND {minified('s.raw')} AS is_minified,
  CASE WHEN r.role = 'library' THEN 0 ELSE len(string_split(s.raw, chr(10))) END AS line_count,
  CASE WHEN r.role <> 'library' THEN {_CLEAN.format(xall('s.raw', COMMENT_TOKENS))} END AS code
  FROM c_scripts s JOIN c_roles0 r ON r.ext_id = s.ext_id AND r.path = s.path) d"""


def placed(source: str, pattern: str) -> str:
    """(ext_id, path, hit, line): every hit of a pattern, its line from what stands between the hits."""
    feeds = "list_sum(list_transform({0}, lambda p: len(p) - len(replace(p, chr(10), ''))))".format
    return f"""SELECT ext_id, path, hits[k] AS hit, (1 + {feeds('gaps[1:k]')} + coalesce({feeds('hits[1:k - 1]')}, 0))::BIGINT AS line FROM (
      SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT ext_id, path, {xall('body', pattern)} AS hits, regexp_split_to_array(body, {q(pattern)}) AS gaps FROM ({source})))"""


_LD = " UNION ALL ".join(
    f"SELECT ext_id, path, line, {q(kind)} AS type, unnest({xall('text', p, 1)}) AS target FROM l" for kind, p in S.LINE_DEPENDENCIES)
CTES["c_edges"] = f"""
WITH l AS (SELECT ext_id, path, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) AS line
  FROM c_described WHERE code IS NOT NULL),
b AS (SELECT ext_id, path, hit AS block, line FROM ({placed("SELECT ext_id, path, code AS body FROM c_described WHERE code IS NOT NULL", S.INJECTED_FILES)})),
h AS (SELECT ext_id, path, hit AS tag, line FROM ({placed(f"SELECT ext_id, path, text AS body FROM c_extra WHERE {m('path', '(?i)[.]html?$')}", S.HTML_SCRIPT)})),
mr AS (SELECT ext_id, unnest(list_concat(content_js, content_css, background, [service_worker, popup, options, devtools, side_panel],
  sandbox, overrides, rule_files)) AS reference FROM c_manifests)
SELECT DISTINCT ext_id, 'manifest.json' AS src, replace(regexp_replace(reference, '^/', ''), chr(92), '/') AS dst, 'manifest' AS type, 1::BIGINT AS line
  FROM mr WHERE reference <> '' AND NOT {m('reference', '(?i)^https?://')}
UNION ALL SELECT ext_id, path, CASE WHEN {m('target', '(?i)^https?://')} THEN target ELSE {resolve(parent('path'), 'target')} END, 'html_script', line
  FROM (SELECT ext_id, path, {x('tag', S.HTML_SCRIPT)} AS target, line FROM h)
UNION ALL SELECT ext_id, path, {resolve(parent('path'), 'target')}, type, line FROM ({_LD}) WHERE {local('target')}
UNION ALL SELECT ext_id, path, {resolve(parent('path'), 'target')}, 'injected_file', line
  FROM (SELECT ext_id, path, line, unnest({xall(x('block', r'[[]([^]]*)[]]'), S.QUOTED, 1)}) AS target FROM b) WHERE {local('target')}"""
CTES["c_unresolved"] = """
SELECT * FROM c_edges e WHERE type <> 'manifest' AND NOT starts_with(dst, 'http')
  AND NOT EXISTS (SELECT 1 FROM c_listing l WHERE l.ext_id = e.ext_id AND l.path = e.dst)"""
CTES["r_reached"] = """
SELECT DISTINCT e.ext_id, e.dst AS path FROM c_edges e JOIN c_listing l ON l.ext_id = e.ext_id AND l.path = e.dst WHERE e.type = 'manifest'
UNION SELECT e.ext_id, e.dst FROM r_reached r JOIN c_edges e ON e.ext_id = r.ext_id AND e.src = r.path
  JOIN c_listing l ON l.ext_id = e.ext_id AND l.path = e.dst WHERE e.type <> 'manifest'"""
CTES["c_files"] = """
SELECT d.* EXCLUDE (base_role), d.base_role, CASE WHEN base_role = 'unknown' AND EXISTS (SELECT 1 FROM c_edges e WHERE e.ext_id = d.ext_id
  AND e.type IN ('injected_file', 'script_injection') AND (d.path = e.dst OR ends_with(d.path, '/' || e.dst)))
  THEN 'content_script' ELSE base_role END AS role FROM c_described d"""
CTES["c_orphans"] = "SELECT ext_id, path, role FROM c_files f WHERE NOT EXISTS (SELECT 1 FROM r_reached r WHERE r.ext_id = f.ext_id AND r.path = f.path)"
_SPLIT = "unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) AS line"
CTES["c_lines"] = f"SELECT ext_id, path, role, {_SPLIT} FROM c_files WHERE code IS NOT NULL"
CTES["c_alllines"] = f"""
SELECT ext_id, path, role, text, line FROM c_lines UNION ALL SELECT l.ext_id, l.path, f.role, unnest(string_split(l.code, chr(10))), l.line
FROM c_layers l JOIN c_files f ON f.ext_id = l.ext_id AND f.path = l.path WHERE l.method <> 'eval_body'"""
CTES["c_units"] = """
SELECT ext_id, path, role, '' AS layer, 0 AS origin, code FROM c_files WHERE code IS NOT NULL
UNION ALL SELECT l.ext_id, l.path, f.role, l.layer, l.line, l.code FROM c_layers l JOIN c_files f ON f.ext_id = l.ext_id AND f.path = l.path"""
# lines are numbered, then those that go on are joined; chr(2) ends a number, chr(11) marks a joint
CTES["c_logical"] = r"""
SELECT ext_id, path, role, layer, origin, regexp_extract(piece, '^[0-9]+')::INT AS line, substring(piece, instr(piece, chr(2)) + 1) AS text FROM (
  SELECT ext_id, path, role, layer, origin, unnest(string_split(regexp_replace(regexp_replace(numbered, '([(\[,+=&|?][ \t\r]*)\n[0-9]+\x02', '\1' || chr(11), 'g'),
    '\n[0-9]+\x02([ \t]*[.)])', chr(11) || '\1', 'g'), chr(10))) AS piece
  FROM (SELECT ext_id, path, role, layer, origin, array_to_string(list_transform(string_split(translate(code, chr(2) || chr(11), '  '), chr(10)), lambda x, i: i || chr(2) || x), chr(10)) AS numbered
    FROM c_units))"""
_PART = "(?:\"[^\"]*\"|'[^']*'|`[^`]*`|[^;])+"
_TOKENS = "\"[^\"]*\"|'[^']*'|`[^`]*`|[()]|[^()\"'`]+|[\"'`]"
_CODELIKE = "[(=\"'`[]|[A-Za-z0-9_$)]\\.[A-Za-z_$]"
_MARKS = "len({0}) - len(replace({0}, chr(11), ''))".format
CTES["c_stmts"] = f"""
SELECT ext_id, path, role, CASE WHEN layer = '' THEN line ELSE origin END::INT AS line, substring(stmt, 1, 240) AS snippet,
  CASE WHEN layer = '' THEN stmt_no ELSE 4294967296 + row_number() OVER (PARTITION BY ext_id, path, layer = '' ORDER BY layer, line, stmt_no) END AS stmt_no, stmt FROM (
  SELECT ext_id, path, role, layer, origin, stmt_no, {sub("translate(part, chr(11), ' ')", TRIM)} AS stmt, (line + {_MARKS(x('part', '^[' + chr(92) + 's' + chr(92) + 'x0B]*', 0))}
    + coalesce(sum({_MARKS('part')}) OVER (PARTITION BY ext_id, path, layer, line ORDER BY stmt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line
  FROM (SELECT ext_id, path, role, layer, origin, line, unnest({xall('text', _PART)}) AS part, generate_subscripts({xall('text', _PART)}, 1) - 1 AS stmt_no
    FROM c_logical WHERE {m('text', _CODELIKE)})) WHERE stmt <> ''"""
CTES["c_tokens"] = f"""
SELECT *, sum(len(tok)) OVER w AS upto, sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth, count(*) FILTER (WHERE tok = '(') OVER w AS nth
FROM (SELECT *, unnest({xall('stmt', _TOKENS)}) AS tok, generate_subscripts({xall('stmt', _TOKENS)}, 1) AS i FROM c_stmts WHERE contains(stmt, '('))
WINDOW w AS (PARTITION BY ext_id, path, line, stmt_no ORDER BY i)"""
CTES["c_calls"] = f"""
SELECT ext_id, path, role, line, snippet, stmt_no, stmt, call_no, callee, {m('head', r'\bnew\s+[A-Za-z_$][A-Za-z0-9_$.]*\s*$')} AS is_new,
  substring(stmt, start + 1, coalesce(stop - 1, len(stmt)) - start) AS args
FROM (SELECT *, {x('head', r'([A-Za-z_$][A-Za-z0-9_$.]*)\s*$')} AS callee FROM (
  SELECT o.*, nth - 1 AS call_no, upto::INT AS start, substring(stmt, before + 1, upto::INT - 1 - before) AS head, c.stop FROM (
    SELECT *, coalesce(lag(upto) OVER (PARTITION BY ext_id, path, line, stmt_no ORDER BY i), 0)::INT AS before FROM c_tokens WHERE tok = '(') o
  LEFT JOIN (SELECT a.ext_id, a.path, a.line, a.stmt_no, a.i, min(b.upto)::INT AS stop FROM c_tokens a JOIN c_tokens b ON a.ext_id = b.ext_id AND a.path = b.path
      AND a.line = b.line AND a.stmt_no = b.stmt_no AND b.i > a.i AND b.depth = a.depth - 1 WHERE a.tok = '(' GROUP BY ALL) c
    ON c.ext_id = o.ext_id AND c.path = o.path AND c.line = o.line AND c.stmt_no = o.stmt_no AND c.i = o.i))
WHERE callee <> '' AND callee NOT IN {inlist(P.KEYWORDS)}"""
_BARE = sub("stmt", r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", '""')
_TARGETS = xall(sub("bare", "[-=!<>+*/%&|^?]*=[=>]+|[-!<>+*/%&|^?]+=", " # "), r"(?:^|[\s{}(,])([A-Za-z_$][A-Za-z0-9_$.]*)\s*=", 1)
CTES["c_members"] = f"""
SELECT ext_id, path, role, line, snippet, object, property, is_write FROM (
  SELECT ext_id, path, role, line, snippet, CASE WHEN seg[1] = '' THEN '?' ELSE array_to_string(seg[1:k], '.') END AS object, seg[k + 1] AS property,
    list_contains(targets, token) AND k = len(seg) - 1 AS is_write
  FROM (SELECT *, string_split(token, '.') AS seg, unnest(range(1, len(string_split(token, '.')))) AS k FROM (
    SELECT *, {_TARGETS} AS targets, unnest({xall('bare', '[A-Za-z0-9_$.]+')}) AS token FROM (SELECT *, {_BARE} AS bare FROM c_stmts WHERE contains(stmt, '.')))
    WHERE contains(token, '.')))
WHERE {m('property', '^[A-Za-z_$]')}"""
_DTOK = "\"[^\"]*\"|'[^']*'|`[^`]*`|[()\\[\\]{}]|[-=!<>+*/%&|^?]*=[=>]*|,|[^()\\[\\]{}\"'`,=!<>+*/%&|^?-]+|."
_NAME = "[A-Za-z_$][A-Za-z0-9_$.]*"
_KEYWORD = r"(?:^|[\s{}(])(?:const|let|var)"
_CALLBACK = r"^\s*(?:async\s*)?(?:function\s*[A-Za-z0-9_$]*\s*)?\(?\s*"


def nested(opening: str, closing: str, inside: str, depth: int) -> str:
    """Pattern of a bracket with brackets inside it, down to a depth."""
    return f"{opening}(?:{inside}{'|' + nested(opening, closing, inside, depth - 1) if depth else ''})*{closing}"


_PATTERN = nested(r"[{\[]", r"[}\]]", r"[^{}\[\]]", 4)
_QUOTED = "\"[^\"]*\"|'[^']*'|`[^`]*`"
_BRACKET = nested(r"[({\[]", r"[)}\]]", _QUOTED + "|[^(){}\\[\\]\"'`]", 3)
_STMT = "ext_id, path, line, stmt_no"
_SAME = "{0}.ext_id = {1}.ext_id AND {0}.path = {1}.path AND {0}.line = {1}.line AND {0}.stmt_no = {1}.stmt_no".format
CTES["c_dtok"] = f"""
SELECT *, sum(len(tok)) OVER w AS upto, sum(CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER w AS depth
FROM (SELECT *, unnest({xall('stmt', _DTOK)}) AS tok, generate_subscripts({xall('stmt', _DTOK)}, 1) AS i FROM c_stmts WHERE contains(stmt, '=') OR contains(stmt, '.then('))
WINDOW w AS (PARTITION BY {_STMT} ORDER BY i)"""
# where a part of a statement begins: after a comma, an opening bracket, or a closing one without a partner
CTES["c_dedge"] = f"""
SELECT {_STMT}, i, upto, depth, tok <> ',' AS opens FROM (
  SELECT *, min(depth) OVER (PARTITION BY {_STMT} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM c_dtok)
WHERE tok IN (',', '(', '[', '{{') OR (tok IN (')', ']', '}}') AND depth < least(coalesce(low, 0), 0))"""
CTES["c_dhead"] = f"""
SELECT e.*, substring(e.stmt, coalesce(b.since, 0)::INT + 1, (e.upto - len(e.tok) - coalesce(b.since, 0))::INT) AS head, coalesce(b.since, 0) AS since, coalesce(b.grp, 0) AS grp, b.last
FROM (SELECT * FROM c_dtok WHERE tok IN ('=', ',') OR (tok = '(' AND substring(stmt, upto::INT - 5, 5) = '.then')) e
LEFT JOIN (SELECT e.ext_id, e.path, e.line, e.stmt_no, e.i, max(b.upto) AS since, max(b.upto) FILTER (WHERE b.opens) AS grp, max(b.i) AS last FROM c_dtok e
    JOIN c_dedge b ON {_SAME('e', 'b')} AND b.i < e.i AND b.depth = e.depth - (e.tok = '(')::INT WHERE e.tok IN ('=', ',', '(') GROUP BY ALL) b
  ON {_SAME('e', 'b')} AND b.i = e.i"""
_TARGET_NAME = x("head", r"(?:^|[\s{}(,])(" + _NAME + r")\s*$")
_TARGET_PATTERN = x("head", rf"(?:^|{_KEYWORD})\s*({_PATTERN})\s*$")
CTES["c_deq"] = f"""
SELECT *, CASE WHEN {_TARGET_NAME} <> '' THEN {_TARGET_NAME} ELSE {_TARGET_PATTERN} END AS target,
  {m('head', _KEYWORD + r'\s+' + _NAME + r'\s*$')} OR {m('head', _KEYWORD + r'\s*' + _PATTERN + r'\s*$')} AS kw, {m('head', r'^\s*(?:' + _NAME + '|' + _PATTERN + r')\s*$')} AS alone
FROM c_dhead WHERE tok = '='"""
CTES["c_dfirst"] = f"SELECT *, row_number() OVER (PARTITION BY {_STMT}, grp, since ORDER BY i) = 1 AS first FROM c_deq WHERE target <> ''"
CTES["c_dlists"] = f"""
SELECT {_STMT}, grp, min(i) AS i FROM (SELECT {_STMT}, grp, i FROM c_dfirst WHERE first AND kw
  UNION ALL SELECT {_STMT}, grp, i FROM c_dhead WHERE tok = ',' AND {m('head', _KEYWORD + r'\s+' + _NAME + r'\s*$')}) GROUP BY ALL"""
CTES["c_binds"] = f"""
SELECT ext_id, path, role, line, snippet, stmt_no, i, CASE WHEN first AND (kw OR (alone AND listed)) THEN 'declared' ELSE 'assigned' END AS kind, target, value FROM (
  SELECT f.*, l.i IS NOT NULL AS listed, {sub("substring(f.stmt, f.upto::INT + 1, (coalesce(s.stop, len(f.stmt)) - f.upto)::INT)", TRIM)} AS value
  FROM c_dfirst f LEFT JOIN c_dlists l ON {_SAME('f', 'l')} AND l.grp = f.grp AND l.i < f.i
  LEFT JOIN (SELECT e.ext_id, e.path, e.line, e.stmt_no, e.i, min(c.upto - len(c.tok)) AS stop FROM c_dfirst e JOIN c_dtok c ON {_SAME('e', 'c')} AND c.i > e.i
      AND ((c.tok = ',' AND c.depth = e.depth) OR (c.tok IN (')', ']', '}}') AND c.depth = e.depth - 1)) GROUP BY ALL) s
    ON {_SAME('f', 's')} AND s.i = f.i)
WHERE value <> ''
UNION ALL
SELECT ext_id, path, role, line, snippet, stmt_no, i, 'promise', {x('after', _CALLBACK + '(' + _NAME + '|' + _PATTERN + ')')} AS target, {sub("substring(head, 1, len(head) - 5)", TRIM)}
FROM (SELECT *, substring(stmt, upto::INT + 1) AS after FROM c_dhead WHERE tok = '(') WHERE target <> ''"""
_NO_DEFAULTS = sub("target", rf"=\s*(?:{_PATTERN}|[^,{{}}\[\]])*")
_NO_KEYS = sub(_NO_DEFAULTS, r"[A-Za-z_$][A-Za-z0-9_$]*\s*:")
CTES["c_names"] = f"SELECT *, unnest({xall(_NO_KEYS, _NAME)}) AS name FROM c_binds"
CTES["c_assigned"] = f"SELECT ext_id, path, role, line, snippet, stmt_no, i, kind, target, value FROM c_binds WHERE kind <> 'promise' AND NOT {m('target', '^[{[]')}"
_ESCAPED = r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`"""
CTES["c_literals"] = f"""
SELECT ext_id, path, role, line, substring(text, greatest(instr(text, quoted) - 80, 1), 240) AS snippet, starts_with(quoted, '`') AS is_template, substring(quoted, 2, len(quoted) - 2) AS value
FROM (SELECT ext_id, path, role, line, text, unnest({xall('text', _ESCAPED)}) AS quoted FROM c_alllines)"""
CTES["c_api"] = f"""
SELECT ext_id, path, role, line, 'chrome.' || n AS api, string_split(n, '.')[1] AS root
FROM (SELECT ext_id, path, role, line, unnest(list_distinct({xall('text', S.API_REFERENCE, 1)})) AS n FROM c_alllines)"""
CTES["c_urls"] = f"""
SELECT ext_id, path, role, line, url, substring(text, greatest(instr(text, url) - 80, 1), 240) AS context, {url_class('url')} AS url_class, {host('url')} AS host
FROM (SELECT ext_id, path, role, line, text, unnest(list_concat(list_distinct({xall('text', S.URL_IN_CODE)}),
  CASE WHEN {m('text', S.DYNAMIC_URL)} THEN ['<dynamic>'] ELSE [] END)) AS url FROM c_alllines)"""
CTES["c_codedomains"] = f"""
SELECT ext_id, path, line, unnest(list_distinct(list_transform(list_concat({xall('text', S.URL_HOST, 1)}, {xall('text', S.BARE_HOST, 1)}),
  lambda d: lower(d)))) AS domain FROM c_alllines"""


def grep(source: str) -> str:
    parts = []
    for label, severity, pattern, root in S.GREP_SIGNALS:
        first = x("raw", pattern, 0)
        at = f"(len({x('raw', '(?s)^(.*?)(?:' + pattern + ')')}) + 1)"
        start = f"greatest({at} - 20, 1)"
        parts.append(f"""SELECT ext_id, path, {q(f'[{severity.upper()}] {label}')} || CASE WHEN {hits('raw', pattern)} > 1 THEN ' (' || {hits('raw', pattern)} || 'x)' ELSE '' END AS label,
  {q(label)} AS signal, {q(severity)} AS severity, {q(root)}::VARCHAR AS root, {hits('raw', pattern)}::BIGINT AS hits,
  len(string_split(substring(raw, 1, {at} - 1), chr(10)))::BIGINT AS line,
  substring(trim(replace(substring(raw, {start}, {at} + len({first}) + 60 - {start}), chr(10), ' ')), 1, 120) AS snippet
  FROM {source} WHERE {m('raw', pattern)}""")
    return " UNION ALL ".join(parts)


CTES["c_bigsignals"] = "SELECT g.*, f.role FROM (" + grep("(SELECT * FROM c_files WHERE code IS NOT NULL)") + ") g JOIN c_files f ON f.ext_id = g.ext_id AND f.path = g.path"


# --- expressions and constants -------------------------------------------------------------------


def pieces(source: str, key: str) -> str:
    """Ordered quoted parts and names of the string expressions of a source."""
    plain = (f"CASE WHEN {x('expr', ATOB)} <> '' THEN '\"' || {b64(x('expr', ATOB))} || '\"' "
             f"ELSE replace(regexp_replace(expr, '\\$\\{{\\s*([^}}]*)\\}}', '\"+\\1+\"', 'g'), '`', '\"') END")
    return f"""
    SELECT {key}, pos, CASE WHEN {m('piece', '^[' + chr(34) + chr(39) + ']')} THEN {sub('piece', '^[' + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$')} END AS literal,
      CASE WHEN NOT {m('piece', '^[' + chr(34) + chr(39) + ']')} THEN piece END AS ref
    FROM (SELECT {key}, unnest({xall('plain', PIECE)}) AS piece, generate_subscripts({xall('plain', PIECE)}, 1) AS pos
      FROM (SELECT *, {plain} AS plain FROM {source}) WHERE {sub('plain', PIECE + '|[' + chr(92) + 's+]')} = '')"""


_ENTRY = rf"^\s*(?:({_NAME})|[\"']([^\"']*)[\"'])\s*:\s*(.*?)\s*$"
CTES["c_decl"] = f"""
SELECT ext_id, path, name, arg_min(expr, (line, stmt_no, i, expr)) AS expr FROM (
  SELECT ext_id, path, line, stmt_no, i, target AS name, value AS expr FROM c_assigned WHERE kind = 'declared' AND NOT contains(target, '.') AND NOT starts_with(value, '{{')
  UNION ALL SELECT ext_id, path, line, stmt_no, i, target || '.' || {x('entry', _ENTRY)} || {x('entry', _ENTRY, 2)}, {x('entry', _ENTRY, 3)}
  FROM (SELECT *, unnest({xall(x('value', rf'^[{{]((?:{_QUOTED}|{_BRACKET}|[^(){{}}])*)[}}]'), rf'(?:{_QUOTED}|{_BRACKET}|[^,(){{}}])+')}) AS entry
    FROM c_assigned WHERE kind = 'declared' AND starts_with(value, '{{')) WHERE {x('entry', _ENTRY, 3)} <> '')
GROUP BY ext_id, path, name"""
CTES["c_pieces0"] = pieces("c_decl", "ext_id, path, name")
CTES["c_pieces"] = """
SELECT p.*, EXISTS (SELECT 1 FROM c_pieces0 n WHERE n.ext_id = p.ext_id AND n.path = p.path AND n.name = p.ref) AS is_const FROM c_pieces0 p"""
_ROUNDS = 12  # more than the longest chain of the corpus
for _i in range(1, _ROUNDS + 1):
    _prev = f"c_pass{_i - 1}" if _i > 1 else "(SELECT NULL::VARCHAR AS ext_id, NULL::VARCHAR AS path, NULL::VARCHAR AS name, NULL::VARCHAR AS value WHERE FALSE)"
    CTES[f"c_pass{_i}"] = f"""
SELECT * FROM {_prev} k0 UNION ALL
SELECT p.ext_id, p.path, p.name, string_agg(coalesce(p.literal, k.value, ''), '' ORDER BY p.pos) AS value
FROM c_pieces p LEFT JOIN {_prev} k ON k.ext_id = p.ext_id AND k.path = p.path AND k.name = p.ref
WHERE NOT EXISTS (SELECT 1 FROM {_prev} d WHERE d.ext_id = p.ext_id AND d.path = p.path AND d.name = p.name)
GROUP BY p.ext_id, p.path, p.name
HAVING NOT bool_or(p.ref IS NOT NULL AND p.is_const AND k.value IS NULL) AND bool_or(coalesce(p.literal, k.value) IS NOT NULL)"""
CTES["c_constants"] = f"SELECT * FROM c_pass{_ROUNDS}"


def resolved(source: str, key: str) -> str:
    """(key, resolved) of the string expressions of a source."""
    cols = [k.strip() for k in key.split(",")]
    pk = ", ".join("p." + c for c in cols)
    return f"""
    SELECT {pk}, string_agg(coalesce(p.literal, k.value, ''), '' ORDER BY p.pos) AS resolved
    FROM ({pieces(source, key)}) p LEFT JOIN c_constants k ON k.ext_id = p.ext_id AND k.path = p.path AND k.name = p.ref
    GROUP BY {pk} HAVING bool_or(coalesce(p.literal, k.value) IS NOT NULL)"""


CTES["c_opens"] = rf"""
SELECT c.* FROM c_calls c WHERE regexp_matches(callee, '^[^.]+\.open$') AND EXISTS (SELECT 1 FROM c_assigned a WHERE a.ext_id = c.ext_id
  AND a.path = c.path AND regexp_matches(a.value, '^new\s+XMLHttpRequest\s*\(') AND a.target = string_split(c.callee, '.')[1])"""
_CHANNEL = f"(is_new AND callee IN {inlist(P.CHANNEL_CONSTRUCTORS)})"
CTES["c_remote"] = rf"""
SELECT DISTINCT ext_id, path, line, tag, {from_literal('resolved')} AS domain FROM ({resolved(r'''(
  SELECT a.ext_id, a.path, a.line, a.stmt_no, a.i, h.tag, a.value AS expr FROM c_assigned a JOIN (
    SELECT ext_id, path, target AS holder, max(lower(regexp_extract(value, '^document\.createElement\(\s*["'']([a-zA-Z0-9_]+)["'']', 1))) AS tag
    FROM c_assigned WHERE lower(regexp_extract(value, '^document\.createElement\(\s*["'']([a-zA-Z0-9_]+)["'']', 1)) IN ('script', 'iframe') GROUP BY ALL) h
  ON h.ext_id = a.ext_id AND h.path = a.path AND regexp_matches(a.target, '^[^.]+\.src$') AND string_split(a.target, '.')[1] = h.holder)''',
  'ext_id, path, line, stmt_no, i, tag')}) WHERE {from_literal('resolved')} IS NOT NULL"""
CTES["c_contactargs"] = f"""
SELECT ext_id, path, line, stmt_no, call_no, arg_no, {argument('args', 'arg_no')} AS expr FROM (
  SELECT *, unnest(range(0, len(string_split(args, ',')))) AS arg_no FROM c_calls WHERE {sink('callee', P.NETWORK_SINKS)} OR {_CHANNEL}
  UNION ALL SELECT *, CASE WHEN len(string_split(args, ',')) > 1 THEN 1 ELSE 0 END FROM c_opens)"""
CTES["c_contacts"] = f"""
SELECT DISTINCT ext_id, path, line, {from_literal('resolved')} AS domain FROM ({resolved('c_contactargs', 'ext_id, path, line, stmt_no, call_no, arg_no')})
WHERE {from_literal('resolved')} IS NOT NULL UNION SELECT ext_id, path, line, domain FROM c_remote"""
CTES["c_fallback"] = """
SELECT DISTINCT d.ext_id, d.path, d.line, d.domain FROM c_codedomains d JOIN c_files f ON f.ext_id = d.ext_id AND f.path = d.path
WHERE f.is_minified AND (f.uses_fetch OR f.uses_xhr)
  AND NOT EXISTS (SELECT 1 FROM c_contacts c WHERE c.ext_id = f.ext_id AND c.path = f.path)"""
_NAVSRC = rf"""(
  SELECT ext_id, path, role, line, stmt_no, snippet, {argument('args', '0')} AS expr FROM c_calls WHERE regexp_matches(callee, '^(window\.)?open$')
  UNION SELECT ext_id, path, role, line, stmt_no, snippet, CASE WHEN starts_with(trim(args), '{{') THEN {sub(x('args', r"\burl[\"']?\s*:\s*([^,{}()]*)"), TRIM)} ELSE {argument('args', '0')} END
    FROM c_calls WHERE regexp_matches(callee, '^chrome\.(tabs|windows)\.create$')
  UNION SELECT ext_id, path, role, line, stmt_no, snippet, value FROM c_assigned WHERE contains(target, '.') AND regexp_matches(target, '\.(href|location)$'))"""
_HAY = "lower(domain || ' ' || resolved || ' ' || snippet)"
_REASON = "concat_ws(', ', " + ", ".join(f"CASE WHEN {m(_HAY, p)} THEN {q(n)} END" for n, p in S.NAVIGATION_REASONS) + ")"
CTES["c_navs"] = f"""
SELECT ext_id, path, role, line, domain, reason, min(snippet) AS snippet, CASE WHEN {m('reason', 'affiliate|domain|product|page')} THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT *, {_REASON} AS reason FROM (SELECT *, {from_literal('resolved')} AS domain FROM ({resolved(f"(SELECT *, expr AS n FROM {_NAVSRC} WHERE expr <> '')", 'ext_id, path, role, line, stmt_no, snippet, n')}))
  WHERE domain IS NOT NULL) WHERE reason <> '' GROUP BY ext_id, path, role, line, domain, reason"""
CTES["c_bound"] = f"""
SELECT ext_id, path, string_split(name, '.')[1] AS var, value AS expr, {direct('value')} AS source FROM c_names WHERE kind <> 'promise' OR {m('value', P.PROMISE_SOURCE)}"""
CTES["r_taint"] = f"""
SELECT ext_id, path, var, source FROM c_bound WHERE source IS NOT NULL
UNION SELECT l.ext_id, l.path, l.var, t.source FROM r_taint t JOIN c_links l ON l.ext_id = t.ext_id AND l.path = t.path AND l.ref = t.var"""
CTES["c_links"] = f"SELECT DISTINCT ext_id, path, var, ref FROM (SELECT ext_id, path, var, unnest({roots('expr')}) AS ref FROM c_bound WHERE source IS NULL) WHERE var <> ref"
CTES["c_tainted"] = "SELECT ext_id, path, var, min(source) AS source FROM r_taint GROUP BY ALL"
_SINKLABEL = (f"CASE WHEN {sink('callee', P.MESSAGE_SINKS)} THEN 'extension message sink ' || callee WHEN {_CHANNEL} THEN callee || ' constructor' "
              f"ELSE 'network sink ' || callee END")
_SINKCONF = f"CASE WHEN {sink('callee', P.MESSAGE_SINKS)} THEN 0.78 WHEN {_CHANNEL} THEN 0.88 ELSE 0.9 END"
CTES["c_sinksites"] = f"""
SELECT *, {direct('args')} AS direct FROM (
  SELECT ext_id, path, role, line, stmt_no, call_no, snippet, args, {_SINKLABEL} AS sink, {_SINKCONF} AS confidence
    FROM c_calls WHERE {sink('callee', P.MESSAGE_SINKS)} OR {sink('callee', P.NETWORK_SINKS)} OR {_CHANNEL}
  UNION ALL SELECT ext_id, path, role, line, stmt_no, call_no, snippet, args, 'XMLHttpRequest URL', 0.84 FROM c_opens)"""
CTES["c_flows"] = f"""
SELECT ext_id, path, role, line, sink, source, min(snippet) AS snippet, max(confidence)::DOUBLE AS confidence, source || ' -> ' || sink AS detail FROM (
  SELECT ext_id, path, role, line, sink, direct AS source, snippet, confidence FROM c_sinksites WHERE direct IS NOT NULL
  UNION ALL SELECT s.ext_id, s.path, s.role, s.line, s.sink, min(t.source), s.snippet, s.confidence
    FROM (SELECT *, unnest({roots('args')}) AS var FROM c_sinksites WHERE direct IS NULL) s JOIN c_tainted t
    ON t.ext_id = s.ext_id AND t.path = s.path AND t.var = s.var GROUP BY s.ext_id, s.path, s.role, s.line, s.stmt_no, s.call_no, s.sink, s.snippet, s.confidence)
GROUP BY ext_id, path, role, line, sink, source"""


# --- pattern findings --------------------------------------------------------------------------------


def _prules(kind: str) -> str:
    vals = [(c, s, o, n) + ("\x01".join(w) if w else None,) for k, c, s, o, n, w in P.PATTERN_ROWS if k == kind]
    return f"(VALUES {rows(vals)}) r(category, severity, rule_object, name, words)"


_HOOK = case([((m('target', p) + (" AND " + m('value', r'^(async\s+)?function\b|=>') if f else "")), q(n)) for n, _, _, p, f in P.HOOK_ROWS])
CTES["c_patterns0"] = rf"""
SELECT ext_id, path, role, line, snippet, callee AS pattern, r.category, r.severity, CASE WHEN callee = 'console.clear' THEN 0.45 ELSE 0.8 END AS confidence
  FROM c_calls c JOIN {_prules('call')} ON c.callee = r.name OR ends_with(c.callee, '.' || r.name)
  WHERE NOT is_new AND NOT regexp_matches(callee, '(^|\.)addEventListener$')
    AND (r.words IS NULL OR len(list_filter(string_split(r.words, chr(1)), lambda w: contains({first_literal('c.args')}, w))) > 0)
UNION ALL SELECT ext_id, path, role, line, snippet, r.name, r.category, r.severity, 0.8 FROM c_calls c JOIN {_prules('listener')} ON {first_literal('c.args')} = r.name
  WHERE regexp_matches(callee, '(^|\.)addEventListener$')
UNION ALL SELECT ext_id, path, role, line, snippet, c.object || '.' || r.name, r.category, r.severity, CASE WHEN r.name IN ('toDataURL', 'getImageData') THEN 0.5 ELSE 0.8 END
  FROM c_members c JOIN {_prules('member')} ON c.property = r.name AND (r.rule_object IS NULL OR r.rule_object = c.object) WHERE NOT (is_write AND r.name IN ('textContent', 'innerText'))
UNION ALL SELECT ext_id, path, role, line, snippet, r.name, r.category, r.severity, 0.8 FROM c_assigned c JOIN {_prules('assignment')} ON ends_with(c.target, '.' || r.name)
UNION ALL SELECT ext_id, path, role, line, snippet, 'script.src assignment', 'injection', 'high', 0.82 FROM c_assigned WHERE ends_with(target, '.src') AND {m('value', P.SCRIPT_VALUE)}
UNION ALL SELECT ext_id, path, role, line, snippet, hook, 'interception', {case([(f"hook = {q(n)}", q(s)) for n, s, _, _, _ in P.HOOK_ROWS])}, {case([(f"hook = {q(n)}", str(c)) for n, _, c, _, _ in P.HOOK_ROWS])}
  FROM (SELECT *, {_HOOK} AS hook FROM c_assigned WHERE contains(target, '.')) WHERE hook IS NOT NULL
UNION ALL SELECT ext_id, path, role, line, snippet, callee, 'exfiltration', CASE WHEN callee = 'fetch' THEN 'medium' ELSE 'high' END, 0.75 FROM c_calls WHERE NOT is_new AND {sink('callee', P.NETWORK_SINKS)}
UNION ALL SELECT ext_id, path, role, line, snippet, callee, 'exfiltration', 'medium', 0.62 FROM c_calls WHERE NOT is_new AND {sink('callee', P.MESSAGE_SINKS)}
UNION ALL SELECT c.ext_id, c.path, c.role, c.line, c.snippet, v.pattern, v.category, v.severity, v.confidence FROM c_calls c JOIN (VALUES
  ('Function', 'new Function', 'injection', 'critical', 0.95), ('WebSocket', 'WebSocket', 'exfiltration', 'high', 0.82), ('EventSource', 'EventSource', 'exfiltration', 'high', 0.82),
  ('RTCPeerConnection', 'new RTCPeerConnection', 'privacy_risk', 'high', 0.78), ('Worker', 'new Worker', 'evasion', 'medium', 0.65), ('SharedWorker', 'new SharedWorker', 'evasion', 'medium', 0.65))
  v(name, pattern, category, severity, confidence) ON c.is_new AND c.callee = v.name
UNION ALL SELECT ext_id, path, role, line, snippet, callee || '(string)', 'injection', 'high', 0.9 FROM c_calls WHERE callee IN ('setTimeout', 'setInterval') AND {first_literal('args')} IS NOT NULL
UNION ALL SELECT ext_id, path, role, line, snippet, CASE WHEN is_template THEN 'credential template:' ELSE 'credential string:' END || {word('value', S.LITERAL_WORDS)}, 'data_theft', 'medium', 0.65
  FROM c_literals WHERE {word('value', S.LITERAL_WORDS)} IS NOT NULL
UNION ALL SELECT ext_id, path, role, line, snippet, 'credential selector:' || w, 'data_theft', CASE WHEN w IN {inlist(S.CRITICAL_SELECTOR_WORDS)} THEN 'critical' ELSE 'high' END, 0.9
  FROM (SELECT *, {word(first_literal('args'), S.SELECTOR_WORDS)} AS w FROM c_calls WHERE {m('callee', P.CREDENTIAL_SELECTOR_CALLS)}) WHERE w IS NOT NULL
UNION ALL SELECT r.ext_id, r.path, f.role, r.line, NULL, r.tag || '.src remote', 'injection', CASE WHEN tag = 'script' THEN 'critical' ELSE 'high' END, CASE WHEN tag = 'script' THEN 0.92 ELSE 0.84 END
  FROM c_remote r JOIN c_files f ON f.ext_id = r.ext_id AND f.path = r.path"""
_KIND = case([
    ("pattern IN ('xhr_prototype_hook', 'fetch_hook', 'history_api_hook')", "'api_hook'"), ("pattern = 'geolocation_api_spoof'", "'api_spoof'"),
    ("pattern = 'document.cookie' OR starts_with(pattern, 'chrome.cookies')", "'cookie_read'"),
    ("contains(pattern, 'Storage') OR starts_with(pattern, 'chrome.storage.')", "'storage_read'"),
    ("pattern IN ('keydown', 'keyup', 'keypress', 'submit', 'input', 'change')", "'input_listener'"),
    (m('pattern', r"^innerHTML$|^outerHTML$|document\.write|createElement|script\.src|iframe\.src|\.src remote|executeScript"), "'dom_injection'")], "'risky_call'")
CTES["c_patterns"] = f"SELECT *, {_KIND} AS kind FROM c_patterns0"

# --- permissions and structures ---------------------------------------------------------------------------

CTES["c_declared"] = " UNION ALL ".join(
    f"SELECT ext_id, raw, unnest({col}) AS permission, {q(src)} AS source FROM c_manifests"
    for col, src in (("api_perms", "permissions"), ("optional_perms", "optional_permissions"), ("host_perms", "host_permissions")))
_EVERY, _ANY = f"d.permission IN {inlist(M.EVERY_SITE)}", m("d.permission", M.SCHEME_PATTERN)
CTES["c_permrisk"] = f"""
SELECT d.ext_id, d.permission, d.source, d.raw, CASE WHEN {_EVERY} THEN 'critical' WHEN {_ANY} THEN 'medium' ELSE coalesce(p.category, 'medium') END AS category,
  CASE WHEN {_EVERY} THEN 10 WHEN {_ANY} THEN 2 ELSE coalesce(p.weight, 2) END AS weight, CASE WHEN {_EVERY} OR {_ANY} THEN TRUE ELSE coalesce(p.host_sensitive, FALSE) END AS host_sensitive
FROM c_declared d LEFT JOIN c_perm p ON p.permission = d.permission"""
CTES["c_used"] = "SELECT DISTINCT ext_id, root AS permission FROM c_api"
CTES["c_apiperms"] = "SELECT DISTINCT ext_id, unnest(api_perms) AS permission FROM c_manifests"
CTES["c_unused"] = "SELECT * FROM c_apiperms a WHERE NOT EXISTS (SELECT 1 FROM c_used u WHERE u.ext_id = a.ext_id AND u.permission = a.permission)"
CTES["c_remotescripts"] = "SELECT ext_id, page, role, src FROM c_pagescripts WHERE path IS NULL"
CTES["c_connect"] = rf"""
SELECT ext_id, 'manifest.json' AS path, 'externally_connectable accepts ' || CASE WHEN len(origins) > 0 THEN array_to_string(origins, ', ') ELSE 'external origins' END
  || CASE WHEN handler THEN ' and code registers onMessageExternal' ELSE '' END AS detail, {line_of('raw', "'externally_connectable'")} AS line,
  CASE WHEN broad THEN 'high' ELSE 'medium' END AS severity, CASE WHEN broad AND handler THEN 0.86 ELSE 0.7 END AS confidence
FROM (SELECT m.ext_id, m.raw, coalesce(json_extract_string(m.raw, '$.externally_connectable.matches[*]'), []) AS origins,
    len(list_filter(coalesce(json_extract_string(m.raw, '$.externally_connectable.matches[*]'), []), lambda o: regexp_matches(o, '<all_urls>|\*://\*|\*\.|https?://\*'))) > 0 AS broad,
    EXISTS (SELECT 1 FROM c_lines l WHERE l.ext_id = m.ext_id AND regexp_matches(l.text, 'chrome\.runtime\.onMessageExternal\.addListener')) AS handler
  FROM c_manifests m WHERE json_extract(m.raw, '$.externally_connectable') IS NOT NULL) WHERE broad OR handler"""
CTES["c_exposed"] = rf"""
SELECT ext_id, 'manifest.json' AS path, 'web_accessible_resources exposes executable resources (' || array_to_string(resources, ', ') || ') to broad page matches (' || array_to_string(matches, ', ') || ')' AS detail,
  {line_of('raw', 'resources[1]')} AS line, 'high' AS severity, 0.78 AS confidence
FROM (SELECT ext_id, raw, coalesce(json_extract_string(e, '$.resources[*]'), []) AS resources, coalesce(json_extract_string(e, '$.matches[*]'), []) AS matches
  FROM (SELECT ext_id, raw, unnest(json_extract(raw, '$.web_accessible_resources[*]')) AS e FROM c_manifests) WHERE json_type(e) = 'OBJECT')
WHERE len(list_filter(resources, lambda r: regexp_matches(r, '(?i)\.(js|mjs|html?)$'))) > 0 AND len(list_filter(matches, lambda r: regexp_matches(r, '<all_urls>|\*://\*'))) > 0"""
CTES["c_rulefiles"] = """
SELECT m.ext_id, m.path, m.name, m.author, e.text, json_valid(e.text) AS ok FROM (SELECT ext_id, name, author, unnest(rule_files) AS path FROM c_manifests) m
LEFT JOIN c_extra e ON e.ext_id = m.ext_id AND e.path = m.path"""
CTES["c_rules"] = """
SELECT ext_id, path, name, author, text, json_extract_string(r, '$.id')::BIGINT AS rule_id, coalesce(json_extract_string(r, '$.action.type'), '') AS action,
  coalesce(json_extract_string(r, '$.action.redirect.url'), json_extract_string(r, '$.action.redirect.extensionPath'), '') AS redirect,
  coalesce(json_extract_string(r, '$.condition.urlFilter'), json_extract_string(r, '$.condition.regexFilter'), '') AS url_filter,
  coalesce(array_to_string(json_extract_string(r, '$.condition.resourceTypes[*]'), ','), '') AS resource_types
FROM (SELECT *, unnest(json_extract(CASE WHEN ok THEN text END, '$[*]')) AS r FROM c_rulefiles WHERE ok)"""
CTES["c_rulehosts"] = f"SELECT *, {from_pattern('redirect')} AS redirect_host, {from_filter('url_filter')} AS source_host FROM c_rules"
CTES["c_ruleclass"] = classified("(SELECT DISTINCT ext_id, name, author, unnest([redirect_host, source_host]) AS domain FROM c_rulehosts)", "s.ext_id, s.domain")
CTES["c_ruleknown"] = f"""
SELECT h.*, a.category AS redirect_class, coalesce(b.category IN {inlist(D.SENSITIVE)}, FALSE) AS from_sensitive,
  {line_of('h.text', "(CASE WHEN redirect <> '' THEN redirect ELSE url_filter END)")} AS line
FROM c_rulehosts h LEFT JOIN c_ruleclass a ON a.ext_id = h.ext_id AND a.domain = h.redirect_host LEFT JOIN c_ruleclass b ON b.ext_id = h.ext_id AND b.domain = h.source_host"""
CTES["c_rulefindings"] = rf"""
SELECT ext_id, path, 'declarativeNetRequest redirects ' || CASE WHEN url_filter <> '' THEN url_filter ELSE 'matched traffic' END || ' to ' || redirect_host || ' (' || redirect_class || ')' AS detail,
  line, CASE WHEN from_sensitive THEN 'critical' ELSE 'high' END AS severity, CASE WHEN from_sensitive THEN 0.93 ELSE 0.84 END AS confidence, 'correlation' AS kind
FROM c_ruleknown WHERE action = 'redirect' AND redirect_host IS NOT NULL AND (redirect_class IN {inlist(['unknown', *D.SENSITIVE])} OR from_sensitive)
UNION ALL SELECT ext_id, path, 'broad declarativeNetRequest ' || action || ' rule applies to ' || resource_types, line, 'high', 0.78, 'correlation'
FROM c_ruleknown WHERE action IN ('modifyHeaders', 'redirect') AND regexp_matches(resource_types, 'main_frame|sub_frame|xmlhttprequest|script') AND regexp_matches(url_filter, '\*://\*/\*|<all_urls>|\|\|')
UNION ALL SELECT ext_id, path, 'declarativeNetRequest rule file could not be parsed: ' || path, 1, 'medium', 0.72, 'unresolved_dependency' FROM c_rulefiles WHERE NOT coalesce(ok, FALSE)"""

# --- domain findings -------------------------------------------------------------------------------------------

CTES["c_named"] = f"""
SELECT d.*, mf.name, mf.author FROM (
  SELECT c.ext_id, c.path, c.line, c.domain, c.stage, f.role, 'code_contact' AS kind FROM (SELECT *, 1 AS stage FROM c_contacts UNION ALL SELECT *, 2 FROM c_fallback) c
    JOIN c_files f ON f.ext_id = c.ext_id AND f.path = c.path
  UNION ALL SELECT ext_id, 'manifest.json', {line_of('raw', 'pattern')}, {from_pattern('pattern')}, 3, 'manifest', 'host_permission'
    FROM (SELECT ext_id, raw, unnest(host_perms) AS pattern FROM c_manifests) WHERE {from_pattern('pattern')} IS NOT NULL) d
JOIN c_manifests mf ON mf.ext_id = d.ext_id"""
CTES["c_domainclass"] = classified("(SELECT DISTINCT ext_id, domain, name, author FROM c_named)", "s.ext_id, s.domain")
CTES["c_domainfindings"] = f"""
SELECT n.ext_id, n.domain, n.kind, k.category, {priority('k.category')} AS priority,
  min(n.stage || '|' || n.path || '|' || lpad(n.line::VARCHAR, 8, '0')) AS ord,
  arg_min(n.path, n.stage || '|' || n.path || '|' || lpad(n.line::VARCHAR, 8, '0')) AS path, arg_min(n.line, n.stage || '|' || n.path || '|' || lpad(n.line::VARCHAR, 8, '0')) AS line,
  arg_min(n.role, n.stage || '|' || n.path || '|' || lpad(n.line::VARCHAR, 8, '0')) AS role
FROM c_named n JOIN c_domainclass k ON k.ext_id = n.ext_id AND k.domain = n.domain
WHERE k.category IN {inlist(['unknown', *D.SENSITIVE])} GROUP BY n.ext_id, n.domain, n.kind, k.category"""

# --- findings -----------------------------------------------------------------------------------------------------

_F = "ext_id, stage, path, role, kind, detail, line, snippet, severity, category, confidence, impact"


def _s(stage, kind, detail, frm, path="path", role="role", line="line", snippet="NULL", severity="NULL", category="NULL", confidence="NULL"):
    return (f"SELECT ext_id, {stage} AS stage, {path} AS path, {role} AS role, {kind} AS kind, {detail} AS detail, {line} AS line, {snippet} AS snippet, "
            f"{severity} AS severity, {category} AS category, ({confidence})::DOUBLE AS confidence FROM {frm}")


CTES["c_streams"] = " UNION ALL ".join([
    _s(1, "'nested_archive'", "'nested archive (' || size_bytes || ' bytes)'", "c_inventory WHERE type = 'archive'", role="'unknown'", line="1"),
    _s(2, "'permission_risky'", "permission || ' (' || category || ', weight=' || weight || ', hostSensitive=' || host_sensitive || ', ' || source || ')'",
       "c_permrisk WHERE category <> 'low'", path="'manifest.json'", role="'manifest'", line=line_of("raw", "permission")),
    _s(3, "'orphan_file'", "'script is not reachable from the dependency graph'", "c_orphans", line="1"),
    _s(4, "'unresolved_dependency'", "type || ' -> ' || dst", "(SELECT u.ext_id, u.src AS path, coalesce(f.role, 'unknown') AS role, u.line, u.type, u.dst FROM c_unresolved u LEFT JOIN c_files f ON f.ext_id = u.ext_id AND f.path = u.src)"),
    _s(5, "'remote_script'", "src", "c_remotescripts", path="page", role="'popup'", line="1"),
    _s(6, "'obfuscated'", "'obfuscated or aggressively minified file'", "c_files WHERE is_obfuscated", line="1"),
    _s(7, "'minified'", "'minified file; findings may be dense'", "c_files WHERE is_minified", line="1"),
    _s(8, "kind", "pattern", "c_patterns", snippet="snippet", severity="severity", category="category", confidence="confidence"),
    _s(9, "'data_flow'", "detail", "c_flows WHERE role <> 'popup'", snippet="snippet", severity="'critical'", category="'exfiltration'", confidence="confidence"),
    _s(10, "'sensitive_navigation'", "'navigation to https://' || domain || ' (' || reason || ')'", "c_navs", snippet="snippet", severity="severity", category="'privacy_risk'", confidence="0.84"),
    _s(11, "kind", "detail", "c_rulefindings", role="'manifest'", severity="severity", confidence="confidence"),
    _s(12, "'correlation'", "detail", "c_connect", role="'manifest'", severity="severity", confidence="confidence"),
    _s(13, "'correlation'", "detail", "c_exposed", role="'manifest'", severity="severity", confidence="confidence"),
    _s(14, "'permission_unused'", "permission", "(SELECT u.*, m.raw FROM c_unused u JOIN c_manifests m ON m.ext_id = u.ext_id)", path="'manifest.json'", role="'manifest'", line=line_of("raw", "permission")),
])


def enriched(source: str) -> str:
    impact = case([
        ("k.impact IS NOT NULL", "k.impact"), ("contains(detail, '<all_urls>')", "2"), ("contains(detail, 'cookies')", "4"), ("contains(detail, 'history')", "3"),
        (m("detail", "weight=(10|5|2|1)"), x("detail", "weight=(10|5|2|1)") + "::DOUBLE"), ("contains(detail, 'eval') OR contains(detail, 'new Function')", "5"),
        ("f.kind = 'obfuscated'", "4"), ("contains(lower(detail), 'password')", "8"), ("f.kind = 'correlation'", "8"),
        ("sev = 'critical'", "7"), ("sev = 'high'", "5"), ("sev = 'medium'", "2")], "1")
    return f"""
    SELECT f.ext_id, stage, path, role, f.kind, detail, line, snippet, sev AS severity, coalesce(f.category, k.category) AS category,
      coalesce(f.confidence, k.confidence::DOUBLE) AS confidence, ({impact})::DOUBLE AS impact,
      lpad(stage::VARCHAR, 2, '0') || '|' || path || '|' || lpad(line::VARCHAR, 8, '0') || '|' || f.kind || '|' || detail AS ord
    FROM (SELECT s.*, coalesce(s.severity, CASE WHEN s.kind = 'permission_risky' THEN CASE WHEN contains(detail, 'critical') THEN 'critical' WHEN contains(detail, 'high') THEN 'high' ELSE 'medium' END END,
      (SELECT severity FROM c_kind WHERE kind = s.kind), 'medium') AS sev FROM {source} s) f JOIN c_kind k ON k.kind = f.kind"""


CTES["c_base"] = enriched("c_streams")
_TESTS = {
    "sink": m("detail", P.SINK_DETAIL), "dynamic_code": m("detail", P.EVAL_DETAIL), "secret": m("detail", P.PASSWORD_DETAIL),
    "cookie": "kind = 'cookie_read'", "storage": "kind = 'storage_read'", "listener": "kind = 'input_listener' AND role IN ('content_script', 'background')",
    "page_injection": "kind = 'dom_injection' AND role = 'content_script'", "flow": "kind = 'data_flow'", "message_flow": f"kind = 'data_flow' AND {m('detail', P.MESSAGE_DETAIL)}",
    "background_sink": f"role = 'background' AND {m('detail', P.SINK_DETAIL)}", "hidden_content": "kind = 'obfuscated' AND role = 'content_script'",
    "any_secret": m("detail", P.SECRET_DETAIL), "hook": "kind = 'api_hook'", "spoof": "kind = 'api_spoof'",
    "script_injection": f"kind = 'dom_injection' AND {m('detail', P.SCRIPT_INJECTION_DETAIL)}"}
_PAIRS = {"cookie_with_sink": "cookie", "listener_with_sink": "listener", "secret_with_sink": "secret", "obfuscated_with_sink": "hidden_content"}
_PLACED = ["dynamic_code", "storage", "page_injection", "flow", "message_flow", "any_secret", "hook", "spoof", "script_injection"]
CTES["c_before"] = "SELECT *, " + ", ".join(f"({t}) AS t_{n}" for n, t in _TESTS.items()) + " FROM c_base WHERE stage < 15"
CTES["c_sinkpaths"] = "SELECT DISTINCT ext_id AS sink_ext, path AS sink_path FROM c_before WHERE t_sink"


def _at(name, cond):
    return ", ".join(f"arg_min({c}, ord) FILTER (WHERE {cond}) AS at_{name}_{c}" for c in ("path", "line", "role"))


CTES["c_codeflags"] = "SELECT b.ext_id, " + ", ".join(
    [f"bool_or(t_{n}) AS {n}" for n in _TESTS if n != "sink"]
    + ["bool_or(t_sink AND NOT regexp_matches(b.path, '(?i)polyfill')) AS sink", "bool_or(t_sink) AS sink_file",
       "count(*) FILTER (WHERE t_any_secret) AS n_secrets", "count(*) FILTER (WHERE t_script_injection) AS n_script_injections"]
    + [_at(n, f"t_{n}") for n in _PLACED] + [_at(flag, f"t_{n} AND sink_path IS NOT NULL") for flag, n in _PAIRS.items()]
    + [f"coalesce(bool_or(t_{n} AND sink_path IS NOT NULL), FALSE) AS {flag}" for flag, n in _PAIRS.items()]
) + " FROM c_before b LEFT JOIN c_sinkpaths s ON sink_ext = b.ext_id AND sink_path = b.path GROUP BY b.ext_id"
CTES["c_urlflags"] = f"""SELECT ext_id, bool_or(url_class IN {inlist(D.EXTERNAL_CLASSES)}) AS external_url, bool_or(url_class IN {inlist(D.SUSPICIOUS_CLASSES)}) AS suspicious_url,
  bool_or(url_class IN ('raw_ip', 'suspicious_tld')) AS ip_or_tld_url FROM c_urls GROUP BY ext_id"""
CTES["c_platforms"] = "SELECT f.ext_id, (" + " + ".join(
    f"bool_or({orlist(f'contains(code, {q(t)})' for t in names)})::INT" for names in D.PLATFORM_TRACES.values()
) + f""")::BIGINT AS n_platforms FROM c_files f JOIN (SELECT ext_id, path FROM c_base WHERE kind = 'api_hook' GROUP BY ALL) h
  ON h.ext_id = f.ext_id AND h.path = f.path WHERE code IS NOT NULL GROUP BY f.ext_id"""
_CF = ["all_sites", "no_ui", *[f"p_{p}" for p in K.CORRELATION_PERMISSIONS], *[n for n in _TESTS if n != "sink"], "sink", "sink_file", "n_secrets", "n_script_injections",
       *_PAIRS, "secret_in_popup", "external_url", "suspicious_url", "ip_or_tld_url", "n_platforms", "obfuscation", "remote_script"]
_CNUM = {"n_secrets", "n_script_injections", "n_platforms"}
_PERMS = "list_concat(api_perms, host_perms, optional_perms)"
CTES["c_flags"] = "SELECT mf.ext_id, " + ", ".join(f"coalesce({c}, {0 if c in _CNUM else 'FALSE'}) AS {c}" for c in _CF) + ", " + ", ".join(
    f"at_{n}_{c}" for n in [*_PLACED, *_PAIRS] for c in ("path", "line", "role")) + f""" FROM (SELECT *, len(list_filter(list_concat(host_perms, matches), lambda p: p IN {inlist(M.EVERY_SITE)})) > 0 AS all_sites,
  popup IS NULL AND options IS NULL AND len(sandbox) = 0 AND len(overrides) = 0 AND n_content_scripts > 0 AS no_ui,
  {', '.join(f"list_contains({_PERMS}, {q(p)}) AS p_{p}" for p in K.CORRELATION_PERMISSIONS)} FROM c_manifests) mf
LEFT JOIN (SELECT *, at_secret_with_sink_role = 'popup' AS secret_in_popup FROM c_codeflags) cf ON cf.ext_id = mf.ext_id LEFT JOIN c_urlflags uf ON uf.ext_id = mf.ext_id LEFT JOIN c_platforms pf ON pf.ext_id = mf.ext_id
LEFT JOIN (SELECT ext_id, bool_or(is_obfuscated) AS obfuscation FROM c_files GROUP BY ext_id) ob ON ob.ext_id = mf.ext_id
LEFT JOIN (SELECT DISTINCT ext_id, TRUE AS remote_script FROM c_remotescripts) rs ON rs.ext_id = mf.ext_id"""
CTES["c_correlations0"] = " UNION ALL ".join(
    f"SELECT ext_id, {q(rule)} AS rule, {q(detail)} AS detail, {q(sev)} AS severity, {conf}::DOUBLE AS confidence, "
    + (f"coalesce(at_{place}_path, 'manifest.json') AS path, coalesce(at_{place}_line, 1) AS line" if place else "'manifest.json' AS path, 1 AS line")
    + f" FROM c_flags WHERE {cond}" for rule, cond, sev, conf, detail, place in K.CORRELATION_RULES)
CTES["c_correlations"] = "SELECT c.*, coalesce(f.role, 'manifest') AS role FROM c_correlations0 c LEFT JOIN c_files f ON f.ext_id = c.ext_id AND f.path = c.path"
CTES["c_allfindings"] = "SELECT * FROM c_base UNION ALL " + enriched(
    "(" + _s(15, "'correlation'", "detail", "c_correlations", severity="severity", confidence="confidence") + ")")
CTES["c_sinkfiles"] = f"""SELECT ext_id, path FROM c_allfindings WHERE {m('detail', P.SINK_DETAIL)} OR kind IN ('data_flow', 'sensitive_navigation')
UNION SELECT ext_id, path FROM c_files WHERE uses_fetch OR uses_xhr"""
_CTX = case(
    [(" AND ".join([f"kind = {q(k)}"] + ([f"role = {q(r)}"] if r != "*" else []) + (["has_sink"] if s == "y" else [])), str(v)) for k, r, s, v in K.CONTEXT_CONFIDENCE]
    + [("kind = 'risky_call'", "CASE WHEN regexp_matches(detail, 'eval|new Function') THEN CASE WHEN role = 'content_script' THEN 0.9 ELSE 0.75 END WHEN has_sink AND role = 'content_script' THEN 0.8 ELSE 0.55 END"),
       ("kind = 'permission_risky'", "CASE WHEN contains(detail, 'critical') THEN 0.45 WHEN contains(detail, 'high') THEN 0.3 ELSE 0.15 END")], "confidence")
CTES["c_findings"] = f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ext_id, path, line, kind, detail ORDER BY ord, confidence DESC, severity) AS rn FROM (
  SELECT * REPLACE (least(1, greatest(0, {_CTX}))::DOUBLE AS confidence) FROM (
    SELECT a.*, s.path IS NOT NULL AS has_sink FROM c_allfindings a LEFT JOIN c_sinkfiles s ON s.ext_id = a.ext_id AND s.path = a.path)
  WHERE NOT (kind IN ('input_listener', 'dom_injection', 'storage_read') AND role IN {inlist(K.UI_ROLES)} AND NOT has_sink)
    AND NOT (kind = 'permission_unused' AND severity = 'low') AND NOT (kind = 'minified' AND role = 'unknown'))) WHERE rn = 1"""
CTES["c_verdicted"] = f"""SELECT *, CASE WHEN confidence >= {K.CONFIRM_AT} THEN 'confirmed' ELSE 'dismissed' END AS verdict,
  {case([(f"kind = {q(k)}", q(t)) for k, t, _ in K.KIND_REASONS])} AS reason FROM c_findings"""
CTES["c_confirmed"] = "SELECT * FROM c_verdicted WHERE verdict = 'confirmed'"
CTES["c_score"] = f"""
SELECT p.ext_id, coalesce(w.weighted, 0) AS weighted, coalesce(u.points, 0)::BIGINT AS url_points, coalesce(d.points, 0)::BIGINT AS domain_points,
  round((coalesce(w.weighted, 0) + coalesce(u.points, 0) + coalesce(d.points, 0))::DECIMAL(20, 6), 1)::DOUBLE AS score FROM c_packages p
LEFT JOIN (SELECT ext_id, sum(impact * {band('confidence')}) AS weighted FROM c_findings GROUP BY ext_id) w ON w.ext_id = p.ext_id
LEFT JOIN (SELECT ext_id, sum({url_points('url_class')}) AS points FROM c_urls GROUP BY ext_id) u ON u.ext_id = p.ext_id
LEFT JOIN (SELECT ext_id, least({K.DOMAIN_CAP}, sum(CASE WHEN category = 'unknown' THEN 1 ELSE 2 END)) AS points FROM c_domainfindings GROUP BY ext_id) d ON d.ext_id = p.ext_id"""
CTES["c_reportscore"] = f"""
SELECT p.ext_id, s.total AS report_score, CASE WHEN s.total IS NOT NULL THEN {level('s.total', K.REPORT_LEVELS)} END AS report_level FROM c_packages p
LEFT JOIN (SELECT ext_id, nullif(sum(impact), 0) AS total FROM c_confirmed GROUP BY ext_id) s ON s.ext_id = p.ext_id"""

# --- categories ------------------------------------------------------------------------------------------------------

CTES["c_apicalls"] = "SELECT * FROM c_api a WHERE NOT EXISTS (SELECT 1 FROM c_verdicted v WHERE v.verdict = 'dismissed' AND v.ext_id = a.ext_id AND v.path = a.path AND v.line = a.line)"
CTES["c_hits"] = " UNION ALL ".join(
    f"SELECT *, {q(cat)} AS risk, {q(rid)} AS rule_id FROM c_confirmed WHERE " + " AND ".join(
        ([f"kind = {q(kind)}"] if kind else []) + ([orlist(m("detail", C.SIGNALS[s]) for s in sig)] if sig else []))
    for cat, rid, kind, sig in C.RULES)
_SIGS = sorted({w[2:] for t in [*(c for s in C.STATES.values() for c in s), *(e[1] for e in C.EVIDENCE), *C.FP_TECHNIQUES]
                for w in re.findall(r"\bs_\w+", t)})
_KINDS = [r[0] for r in K.KIND_ROWS]
CTES["c_fflags"] = "SELECT ext_id, " + ", ".join(
    [f"bool_or(kind = {q(k)}) AS k_{k}" for k in _KINDS] + [f"bool_or({m('detail', C.SIGNALS[s])}) AS s_{s}" for s in _SIGS]
    + [f"bool_or(kind = 'data_flow' AND {m('detail', C.SIGNALS[s])}) AS {n}" for n, s in C.FLOW_SIGNALS.items()]
    + [f"bool_or(kind = 'permission_risky' AND {m('detail', C.BROAD_DETAIL)}) AS broad_permission"]) + " FROM c_confirmed GROUP BY ext_id"
_EXEC = m("api", C.API_USE["a_script_execute"])
CTES["c_aflags"] = "SELECT ext_id, " + ", ".join(f"bool_or({m('api', p)}) AS {n}" for n, p in C.API_USE.items()) + (
    f", arg_min(role, (path, line, role)) FILTER (WHERE {_EXEC}) = 'background' AS first_execute_background FROM c_apicalls GROUP BY ext_id")


def _any(col, cond):
    return f"len(list_filter({col}, lambda z: {cond})) > 0"


_HB = "(service_worker IS NOT NULL OR len(background) > 0)"
_BROADIN = f"z IN {inlist(M.BROAD_HOSTS)}"
CTES["c_sflags"] = "SELECT ext_id, " + ", ".join(f"list_contains(list_concat(api_perms, optional_perms), {q(p)}) AS p_{p}" for p in C.FLAG_PERMISSIONS) + f""",
  {_any('matches', _BROADIN)} AS broad_match, {_any('list_concat(host_perms, matches)', _BROADIN)} AS broad_pattern, n_content_scripts > 0 AS has_content_script, auto_run, {_HB} AS has_background,
  ({_HB} OR n_content_scripts > 0) AND popup IS NULL AND options IS NULL AND side_panel IS NULL AS invisible_execution,
  ({_any('matches', f"z IN {inlist(M.EVERY_SITE)} OR {m('z', C.SENSITIVE_ACCESS_HOST)}")} OR {_any('host_perms', m('z', C.SENSITIVE_ACCESS_HOST))}) AS sensitive_reach,
  {_any('matches', m('z', C.SENSITIVE_READ_HOST))} AS matches_read_host FROM c_manifests"""
_BOOLS = [*[f"k_{k}" for k in _KINDS], *[f"s_{s}" for s in _SIGS], *C.FLOW_SIGNALS, "broad_permission", *C.API_USE, "first_execute_background"]
CTES["c_cflags0"] = "SELECT s.*, " + ", ".join(f"coalesce({b}, FALSE) AS {b}" for b in _BOOLS) + """, coalesce(n_contacts, 0) AS n_contacts
FROM c_sflags s LEFT JOIN c_fflags f ON f.ext_id = s.ext_id LEFT JOIN c_aflags a ON a.ext_id = s.ext_id
LEFT JOIN (SELECT ext_id, count(*) AS n_contacts FROM c_domainfindings WHERE kind = 'code_contact' GROUP BY ext_id) c ON c.ext_id = s.ext_id"""
CTES["c_cflags"] = "SELECT *, broad_permission OR broad_match AS broad_host, " + " + ".join(f"{t}::INT" for t in C.FP_TECHNIQUES) + " AS n_techniques FROM c_cflags0"
CTES["c_states0"] = " UNION ALL ".join(
    f"SELECT ext_id, {q(n)} AS risk, {q(title)} AS title, {pr} AS priority, CASE WHEN {C.STATES[n][0]} THEN 'critical' WHEN {C.STATES[n][1]} THEN 'suspicious' "
    f"WHEN {C.STATES[n][2]} THEN 'capability' ELSE 'none' END AS state FROM c_cflags" for n, title, pr in C.CATEGORIES)
CTES["c_states"] = """
SELECT s.ext_id, s.risk, s.title, s.priority, CASE WHEN s.state = 'none' AND r.rules IS NOT NULL THEN 'capability' ELSE s.state END AS state, coalesce(r.rules, '') AS rules,
  CASE WHEN s.state = 'critical' THEN 4 WHEN s.state = 'suspicious' THEN 3 WHEN s.state = 'capability' OR r.rules IS NOT NULL THEN 2 ELSE 1 END AS weight
FROM c_states0 s LEFT JOIN (SELECT ext_id, risk, string_agg(DISTINCT rule_id, ', ' ORDER BY rule_id) AS rules FROM c_hits GROUP BY ext_id, risk) r ON r.ext_id = s.ext_id AND r.risk = s.risk"""
CTES["c_counts"] = f"""SELECT ext_id, count(*) FILTER (WHERE state = 'critical') AS n_critical, count(*) FILTER (WHERE state = 'suspicious') AS n_suspicious,
  count(*) FILTER (WHERE state = 'capability') AS n_capability, bool_or(state = 'critical' AND risk IN {inlist(C.DIRECT_ABUSE)}) AS direct_abuse FROM c_states GROUP BY ext_id"""
_V = [("direct_abuse", "malicious", "critical"), ("n_critical > 0 OR n_suspicious >= 3", "suspicious", "high"), ("n_suspicious > 0 OR n_capability >= 3", "suspicious", "medium"),
      ("n_capability > 0", "benign", "medium")]
CTES["c_verdict"] = f"SELECT *, {case([(c, q(v)) for c, v, _ in _V], q('benign'))} AS verdict, {case([(c, q(lv)) for c, _, lv in _V], q('low'))} AS level FROM c_counts"
_SENS = f"category IN {inlist(C.SENSITIVE_DOMAIN_CATEGORIES)}"
CTES["c_evidence0"] = " UNION ALL ".join(
    [f"SELECT ext_id, {q(r)} AS risk, {q(f'1|{i:04d}')} AS ord, {q(t)} AS text FROM c_cflags WHERE {c}" for i, (r, c, t) in enumerate(C.EVIDENCE)]
    + [f"SELECT ext_id, {q(r)}, {q(f'2|{i:04d}')}, {q(t)} FROM c_cflags WHERE {c}" for i, (r, c, t) in enumerate(C.MANIFEST_EVIDENCE)]
    + ["SELECT ext_id, risk, '3|' || ord, rule_id || ' at ' || path || ':' || line FROM c_hits",
       "SELECT ext_id, 'tracking', '4|' || ord, 'Contacts ' || domain || ' (' || category || ')' FROM c_domainfindings WHERE kind = 'code_contact'",
       f"SELECT ext_id, 'browser_access', '4|' || ord, 'Code refers to ' || domain || ' (' || category || ')' FROM c_domainfindings WHERE kind = 'code_contact' AND {_SENS}",
       "SELECT ext_id, 'browser_access', '4|' || ord, 'Declares host permission for ' || domain FROM c_domainfindings WHERE kind = 'host_permission'",
       f"SELECT ext_id, 'credential_capture', '4|' || ord, 'Declares host permission for sensitive site ' || domain || ' (' || category || ')' FROM c_domainfindings WHERE kind = 'host_permission' AND {_SENS}",
       f"SELECT ext_id, 'history_access', '4|' || ord, 'Host permission may reveal addresses at ' || domain FROM c_domainfindings WHERE kind = 'host_permission' AND {_SENS}"])
CTES["c_evidence"] = f"""
SELECT ext_id, risk, text, rank FROM (SELECT ext_id, risk, text, row_number() OVER (PARTITION BY ext_id, risk ORDER BY ord, text) AS rank
  FROM (SELECT ext_id, risk, text, min(ord) AS ord FROM c_evidence0 GROUP BY ext_id, risk, text)) WHERE rank <= {K.EVIDENCE_LIMIT}"""
_REPLY = lambda r: f"max(CASE WHEN risk = {q(r)} THEN CASE WHEN state = 'critical' THEN 'yes' WHEN state IN ('suspicious', 'capability') THEN 'possible' ELSE 'no' END END)"
CTES["c_answers"] = "SELECT ext_id, " + ", ".join(f"{_REPLY(r)} AS {n}" for n, r in C.ANSWERS) + f""",
  CASE WHEN bool_or(risk IN {inlist(C.SPYING)} AND state = 'critical') THEN 'yes' WHEN bool_or(risk IN {inlist(C.SPYING)} AND state = 'suspicious') THEN 'possible' ELSE 'no' END AS can_spy_unnoticed
FROM c_states GROUP BY ext_id"""
CTES["c_sentence"] = """
SELECT ext_id, CASE WHEN body = '' THEN 'No significant signals.' ELSE 'Detected ' || body || '.' END AS summary FROM (SELECT ext_id, concat_ws('; ',
  CASE WHEN bool_or(state = 'critical') THEN count(*) FILTER (WHERE state = 'critical') || ' critical: ' || string_agg(title, ', ' ORDER BY priority DESC) FILTER (WHERE state = 'critical') END,
  CASE WHEN bool_or(state = 'suspicious') THEN count(*) FILTER (WHERE state = 'suspicious') || ' suspicious: ' || string_agg(title, ', ' ORDER BY priority DESC) FILTER (WHERE state = 'suspicious') END,
  CASE WHEN bool_or(state = 'capability') THEN count(*) FILTER (WHERE state = 'capability') || ' capabilities: ' || string_agg(title, ', ' ORDER BY priority DESC) FILTER (WHERE state = 'capability') END) AS body
  FROM c_states GROUP BY ext_id)"""


def build(final: str) -> str:
    """A query with the tables it needs in front, in order of use."""
    order: list[str] = []

    def visit(sql: str, seen: tuple = ()) -> None:
        for name in re.findall(r"\b[cr]_[a-z0-9]+\b", sql):
            if name in CTES and name not in order and name not in seen:
                visit(CTES[name], (*seen, name))
                order.append(name)

    visit(final)
    if not order:
        return final
    parts = [f"{n} AS ({CTES[n]})" if n.startswith("r_") else f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final
