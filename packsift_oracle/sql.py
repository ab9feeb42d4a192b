"""DuckDB SQL for every query with an exact SQL form."""

from __future__ import annotations

from packsift.catalog import categories as C
from packsift.catalog import domains as D
from packsift.catalog import findings as K
from packsift.catalog import permissions as M
from packsift.catalog import signals as S

from .tables import (
    band, build, case, classified, entity, entity_category, entropy, from_filter, from_literal, from_pattern, grep, host, inlist, level, local,
    line_of, m, minified, obfuscated, priority, q, qlist, registrable, resolve, resource_type, rows, scheme, labels, url_class, url_points,
)

SQL: dict[str, str] = {}


def _url_reasons(u: str) -> str:
    h, s = host(u), scheme(u)
    return f"""CASE WHEN {u} = '<dynamic>' THEN 'constructed at run time' WHEN {h} IS NULL OR {s} IS NULL THEN 'cannot be parsed'
    WHEN {h} IN {inlist(D.NAMESPACE_HOSTS)} THEN 'namespace, not an endpoint' ELSE concat_ws(', ', CASE WHEN {s} <> 'https' THEN 'not https' END,
      CASE WHEN {m(h, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$')} THEN 'raw IP address' END,
      CASE WHEN {h} IN ('localhost', '127.0.0.1') OR ends_with({h}, '.local') THEN 'local endpoint' END,
      CASE WHEN {labels(h, 1)} IN {inlist(D.BAD_TLDS)} THEN 'suspicious TLD .' || {labels(h, 1)} END) END"""


SQL["url_risk_by_domain"] = f"""
SELECT {registrable('host')} AS domain, host, url_class, count(*) AS n_pages, sum({url_points('url_class')})::BIGINT AS points
FROM (SELECT {host('url')} AS host, {url_class('url')} AS url_class FROM pages) GROUP BY ALL"""
SQL["url_classes"] = f"""
SELECT page_id, variant, {scheme('address')} AS protocol, {host('address')} AS host, {url_class('address')} AS url_class, {_url_reasons('address')} AS reasons FROM (
  SELECT page_id, unnest(v) AS address, generate_subscripts(v, 1) - 1 AS variant FROM (SELECT page_id, [url, 'https://' || {host('url')} || '.top/x',
    'https://10.0.' || (page_id % 256) || '.7/p', 'http://node' || page_id || '.local/a', 'https://api' || page_id || '.mixpanel.com/track', '<dynamic>', 'not a url ' || page_id] AS v FROM pages))"""
SQL["registrable_domains"] = f"""
SELECT page_id, host, {registrable('host')} AS domain FROM (SELECT page_id, unnest([{host('url')}, 'www.' || {host('url')}, {host('url')} || '.co.uk',
  {host('url')} || '.ai', string_split({host('url')}, '.')[1]]) AS host FROM pages)"""
SQL["sql_functions"] = f"""
SELECT page_id, {host('url')} AS host, {registrable(host('url'))} AS domain, {url_class('url')} AS url_class, 'docs/' || {host('url')} || '/x.js' AS path FROM pages"""
SQL["pattern_hosts"] = f"""
SELECT page_id, variant, {from_pattern('value')} AS by_pattern, {from_filter('value')} AS by_filter, {from_literal('value')} AS by_literal FROM (
  SELECT page_id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS variant FROM (SELECT page_id, ['*://*.' || {host('url')} || '/*', '||' || {host('url')} || '^',
    {host('url')} || '/path?x=1', '<all_urls>', '*://*/*', 'wss://' || upper({host('url')}) || ':443/s', 'http://www.w3.org/2000/svg', '/relative/' || {host('url')}] AS v FROM pages))"""
SQL["relative_paths"] = f"""
SELECT DISTINCT page_id, target, {resolve("'docs/en'", 'target')} AS resolved, {local('target')} AS is_local, {resource_type('target')} AS type FROM (
  SELECT page_id, unnest([href, '.' || href, '../..' || href || '/./x.js?v=1', 'a/../b' || href, '../../../up' || href]) AS target FROM (
    SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages))"""
_ALL = sorted(r[0] for r in D.DOMAIN_ROWS)
SQL["domain_categories"] = f"""
SELECT DISTINCT page_id, domain, category, platform, ({priority('category')})::BIGINT AS priority FROM ({classified(f'''(
  SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '广告助手' WHEN page_id % 2 = 0 THEN 'Example Site Helper' ELSE 'Thth Reader' END AS name, CASE WHEN page_id % 3 = 0 THEN 'Amazonia Team' END AS author,
    unnest([host, pick, 'www.' || pick, 'x.' || pick, 'data' || page_id || '.gov.co', 'cdn.oxylabs.io', 'amazon.co.uk', 'app.run.app']) AS domain
  FROM (SELECT page_id, {host('url')} AS host, {qlist(_ALL)}[page_id % {len(_ALL)} + 1] AS pick FROM pages))''', 's.page_id, s.domain')})"""
SQL["store_category"] = f"""
SELECT page_id, CASE WHEN page_id % 5 < 2 THEN CASE WHEN page_id % 2 = 0 THEN 'Developer Tools' ELSE 'Shopping' END
  ELSE {case([(f"contains(html || w, {q(c)})", q(c)) for c in D.STORE_CATEGORIES])} END AS category
FROM (SELECT page_id, html, CASE WHEN page_id % 5 = 3 THEN ' Privacy & Security ' WHEN page_id % 5 = 4 THEN ' Games Travel ' ELSE '' END AS w FROM pages)"""

SQL["resource_inventory"] = "SELECT * FROM c_inventory"
SQL["content_hashes"] = """
SELECT ext_id, path, sha256(text) AS sha256, regexp_replace(string_split(path || ' (1).zip', '/')[-1], '[^a-zA-Z0-9._-]', '_', 'g') AS safe_name FROM c_all"""
_NO = "replace(ext_id, 'ext-', '')::BIGINT"
_ENTRIES = f"""SELECT ext_id AS name, path, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM c_all
  WHERE {_NO} % 11 <> 5 AND {_NO} % 13 <> 6 AND NOT ({_NO} % 17 = 7 AND path = 'manifest.json')"""
_REJECTS = f"""SELECT ext_id AS name, CASE WHEN {_NO} % 11 = 5 THEN NULL WHEN {_NO} % 13 = 6 THEN '../evil.js' ELSE 'manifest.json' END AS path,
  CASE WHEN {_NO} % 11 = 5 THEN 'not a zip archive' WHEN {_NO} % 13 = 6 THEN 'unsafe path' ELSE 'unreadable entry (BadZipFile)' END AS reject
  FROM c_packages WHERE {_NO} % 11 = 5 OR {_NO} % 13 = 6 OR {_NO} % 17 = 7"""
SQL["unpacked_entries"] = _ENTRIES
SQL["package_rejects"] = _REJECTS
SQL["arrived_packages"] = f"""
SELECT name, count(sha256) AS n_entries, count(reject) AS n_rejects, sum(n_bytes)::BIGINT AS n_bytes, max(reject) AS reject
FROM (SELECT name, n_bytes, sha256, NULL AS reject FROM ({_ENTRIES}) UNION ALL SELECT name, NULL, NULL, reject FROM ({_REJECTS})) GROUP BY name"""
SQL["nested_archives"] = "SELECT ext_id, path, size_bytes FROM c_inventory WHERE type = 'archive'"
SQL["manifest_facts"] = "SELECT ext_id, version::BIGINT AS version, name, ext_version, author, " + ", ".join(
    f"array_to_string({c}, ', ') AS {c}" for c in ("api_perms", "host_perms", "optional_perms", "matches", "content_js", "content_css", "background", "sandbox", "overrides", "rule_files")
) + ", n_content_scripts::BIGINT AS n_content_scripts, auto_run, service_worker, popup, options, devtools, side_panel FROM c_manifests"
SQL["manifest_rejects"] = "SELECT ext_id || '-cut' AS ext_id, 'manifest is not a JSON object' AS reject FROM c_mtext WHERE NOT json_valid(left(text, 100))"
SQL["locale_messages"] = "SELECT ext_id, locale, key, message FROM c_messages"
SQL["file_roles"] = "SELECT ext_id, path, role, base_role FROM c_files"
SQL["file_flags"] = "SELECT ext_id, path, is_obfuscated, is_minified, line_count::BIGINT AS line_count, uses_fetch, uses_xhr, uses_eval, uses_dom_write FROM c_files"
SQL["text_predicates"] = f"SELECT ext_id, path, {obfuscated('raw')} AS indicated, {minified('raw')} AS minified, round({entropy('raw')}, 6) AS entropy FROM c_scripts"
SQL["character_entropy"] = """
SELECT source, id, part, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM (SELECT source, id, part, count(*)::DOUBLE AS n, any_value(total)::DOUBLE AS total FROM (
  SELECT source, id, part, len(text) AS total, unnest(string_split(text, '')) AS ch FROM (
    SELECT 'documents' AS source, doc_id AS id, 0 AS part, text FROM documents UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations) WHERE len(text) > 0)
  GROUP BY source, id, part, ch) GROUP BY source, id, part"""
SQL["obfuscated_packages"] = "SELECT ext_id, count(*) FILTER (WHERE is_obfuscated) AS obfuscated_files, bool_or(is_obfuscated) AS has_obfuscation FROM c_files GROUP BY ext_id"
SQL["cleaned_code"] = "SELECT ext_id, path, md5(code) AS code_md5, len(string_split(code, chr(10))) AS n_lines FROM c_files WHERE code IS NOT NULL"
SQL["code_line_counts"] = "SELECT ext_id, path, count(*) AS n_lines, max(line) AS last_line, sum(len(text))::BIGINT AS n_chars FROM c_lines GROUP BY ext_id, path"
SQL["code_urls"] = "SELECT ext_id, path, line, url, context, url_class, host FROM c_urls"
SQL["code_domains"] = "SELECT ext_id, path, line, domain FROM c_codedomains"
SQL["api_references"] = "SELECT * FROM c_api"
SQL["text_signals"] = grep("c_scripts")
SQL["large_file_signals"] = "SELECT ext_id, path, role, label, signal, severity, root, hits, line, snippet FROM c_bigsignals"
SQL["decoded_literals"] = "SELECT * FROM c_decoded"
SQL["decoded_layers"] = "SELECT ext_id, path, layer, parent, depth, method, spot AS \"offset\", line, decoded FROM c_layers"
SQL["call_sites"] = "SELECT ext_id, path, line, stmt_no, call_no, callee, is_new, args FROM c_calls"
SQL["member_sites"] = "SELECT ext_id, path, line, object, property, is_write, count(*) AS n FROM c_members GROUP BY ALL"
SQL["assignments"] = "SELECT ext_id, path, line, stmt_no, target, value FROM c_assigned"
SQL["bound_names"] = "SELECT ext_id, path, line, kind, name, value, count(*) AS n FROM c_names GROUP BY ALL"
SQL["code_literals"] = "SELECT ext_id, path, line, is_template, value, count(*) AS n FROM c_literals GROUP BY ALL"
SQL["dom_selectors"] = r"""
SELECT ext_id, path, line, 'document.' || string_split(callee, '.')[-1] AS method, l[2:-2] AS selector FROM (SELECT *, regexp_extract(args, '^\s*("[^"]*"|''[^'']*'')', 1) AS l FROM c_calls)
WHERE l <> '' AND regexp_matches(callee, '(^|\.)document\.(querySelector|querySelectorAll|getElementById|getElementsByClassName|getElementsByTagName|getElementsByName)$')"""

SQL["dependency_edges"] = "SELECT ext_id, src, dst, type, line FROM c_edges"
SQL["unresolved_dependencies"] = "SELECT ext_id, src, dst, type, line FROM c_unresolved"
SQL["reachable_files"] = "SELECT ext_id, path FROM r_reached"
SQL["orphan_scripts"] = "SELECT ext_id, path, role FROM c_orphans"
SQL["remote_scripts"] = "SELECT ext_id, page, role, src FROM c_remotescripts"

SQL["permission_risk"] = f"SELECT ext_id, permission, source, category, weight::BIGINT AS weight, host_sensitive, ({line_of('raw', 'permission')})::BIGINT AS line FROM c_permrisk"
SQL["permission_sets"] = """
SELECT ext_id, count(*) AS n, 'declared' AS part FROM (SELECT DISTINCT ext_id, permission FROM c_declared) GROUP BY ext_id
UNION ALL SELECT ext_id, count(*), 'used' FROM (SELECT ext_id, permission FROM c_apiperms INTERSECT SELECT ext_id, permission FROM c_used) GROUP BY ext_id
UNION ALL SELECT ext_id, count(*), 'unused' FROM (SELECT ext_id, permission FROM c_apiperms EXCEPT SELECT ext_id, permission FROM c_used) GROUP BY ext_id
UNION ALL SELECT ext_id, count(*), 'either' FROM (SELECT ext_id, permission FROM c_apiperms UNION SELECT ext_id, permission FROM c_used) GROUP BY ext_id"""
_UNUSED = f"""
SELECT u.ext_id, u.permission, coalesce((SELECT min(category) FROM c_permrisk r WHERE r.ext_id = u.ext_id AND r.permission = u.permission), t.category, 'medium') AS category,
  coalesce(t.sentence, 'Permission ' || u.permission || ' is declared but was not seen in code.') AS description
FROM c_unused u LEFT JOIN (VALUES {rows(M.DESCRIPTION_ROWS)}) t(permission, category, sentence) ON t.permission = u.permission"""
SQL["unused_permissions"] = _UNUSED
SQL["broad_hosts"] = f"""
SELECT * FROM (SELECT ext_id, unnest(host_perms) AS pattern, 'host_permissions' AS source FROM c_manifests UNION ALL SELECT ext_id, unnest(matches), 'content_scripts' FROM c_manifests)
WHERE pattern IN {inlist(M.BROAD_HOSTS)}"""
SQL["external_connections"] = "SELECT ext_id, path, detail, line::BIGINT AS line, severity, confidence::DOUBLE AS confidence FROM c_connect"
SQL["exposed_executables"] = "SELECT ext_id, path, detail, line::BIGINT AS line, severity, confidence::DOUBLE AS confidence FROM c_exposed"
SQL["network_rules"] = "SELECT ext_id, path, rule_id, action, redirect, url_filter, resource_types FROM c_rules"
SQL["network_rule_findings"] = "SELECT ext_id, path, detail, line::BIGINT AS line, severity, confidence::DOUBLE AS confidence, kind FROM c_rulefindings"

SQL["pattern_findings"] = """
SELECT ext_id, path, line, pattern, kind, category, severity, count(*) AS n, max(confidence)::DOUBLE AS confidence FROM c_patterns GROUP BY ext_id, path, line, pattern, kind, category, severity"""
_SINKS = "SELECT ext_id, path, line, callee AS pattern, 'exfiltration' AS category, {} AS severity, {}::DOUBLE AS confidence FROM c_calls WHERE NOT is_new AND {}"


def _sink(names):
    return "(" + " OR ".join(f"callee = {q(n)} OR ends_with(callee, {q('.' + n)})" for n in names) + ")"


from packsift.catalog import patterns as P  # noqa: E402

SQL["sink_calls"] = (_SINKS.format("CASE WHEN callee = 'fetch' THEN 'medium' ELSE 'high' END", 0.75, _sink(P.NETWORK_SINKS)) + " UNION ALL "
                     + _SINKS.format("'medium'", 0.62, _sink(P.MESSAGE_SINKS)))
SQL["native_api_hooks"] = f"""
SELECT ext_id, path, line, pattern, severity, confidence::DOUBLE AS confidence FROM c_patterns
WHERE pattern IN ('innerHTML', 'script.src assignment', 'xhr_prototype_hook', 'fetch_hook', 'history_api_hook', 'geolocation_api_spoof')"""
SQL["credential_words"] = "SELECT ext_id, path, line, pattern, severity, count(*) AS n FROM c_patterns WHERE starts_with(pattern, 'credential ') GROUP BY ALL"
SQL["string_constants"] = "SELECT * FROM c_constants"
SQL["contacted_domains"] = "SELECT ext_id, path, line, domain FROM c_contacts"
SQL["fallback_domains"] = "SELECT ext_id, path, line, domain FROM c_fallback"
SQL["remote_elements"] = "SELECT ext_id, path, line, tag, domain FROM c_remote"
SQL["tainted_variables"] = "SELECT ext_id, path, var, source FROM c_tainted"
SQL["data_flows"] = "SELECT ext_id, path, line, sink, source, detail, confidence FROM c_flows"
SQL["external_navigations"] = "SELECT ext_id, path, line, domain, reason, severity FROM c_navs"

SQL["findings_by_stream"] = """
SELECT stage::BIGINT AS stage, kind, severity, category, count(*) AS n, round(sum(impact), 6) AS impact, round(sum(confidence), 6) AS confidence FROM c_base GROUP BY stage, kind, severity, category"""
SQL["correlations"] = "SELECT ext_id, path, rule, detail, severity, confidence, line::BIGINT AS line, role FROM c_correlations"
from .tables import _CF, _CNUM  # noqa: E402

SQL["correlation_flags"] = "SELECT ext_id, " + ", ".join(f"{c}::BIGINT AS {c}" if c in _CNUM else c for c in _CF) + " FROM c_flags"
SQL["platform_traces"] = "SELECT ext_id, n_platforms FROM c_platforms"
SQL["sink_files"] = "SELECT ext_id, path FROM c_sinkfiles"
SQL["final_findings"] = "SELECT ext_id, path, line::BIGINT AS line, kind, detail, role, severity, category, confidence, impact FROM c_findings"
SQL["finding_verdicts"] = "SELECT ext_id, kind, verdict, reason, count(*) AS n FROM c_verdicted GROUP BY ALL"
SQL["domain_findings"] = """
SELECT ext_id, domain, kind, category, priority::BIGINT AS priority, 'confirmed' AS verdict, CASE WHEN category = 'unknown' THEN 'unknown domain, ' ||
  CASE WHEN kind = 'host_permission' THEN 'declared in host permissions' ELSE 'seen in code' END ELSE 'sensitive domain: ' || category END AS reason,
  CASE WHEN category = 'unknown' THEN 'unknown' ELSE 'sensitive' END AS list, path, line::BIGINT AS line FROM c_domainfindings"""
SQL["entity_summary"] = f"""
SELECT ext_id, {entity('domain')} AS entity, {entity_category('domain')} AS category, count(DISTINCT domain) AS n_hosts, string_agg(DISTINCT method, ', ' ORDER BY method) AS methods FROM (
  SELECT ext_id, domain, CASE WHEN kind = 'host_permission' THEN 'host_permissions' ELSE 'url_in_code' END AS method FROM c_domainfindings
  UNION ALL SELECT ext_id, lower(regexp_extract(detail, '(?i)https?://([a-zA-Z0-9][-a-zA-Z0-9.]+)', 1)), 'dom_href' FROM c_findings WHERE kind = 'sensitive_navigation'
  UNION ALL SELECT ext_id, {from_pattern('p')}, 'content_scripts' FROM (SELECT ext_id, unnest(matches) AS p FROM c_manifests))
WHERE domain <> '' GROUP BY ALL"""
SQL["audit_score"] = f"SELECT ext_id, round(weighted, 4) AS weighted, url_points, domain_points, score, {level('score', K.AUDIT_LEVELS)} AS level FROM c_score"
SQL["score_reasons"] = f"""
SELECT ext_id, reason, rank FROM (SELECT ext_id, reason, row_number() OVER (PARTITION BY ext_id ORDER BY ord) AS rank FROM (
  SELECT ext_id, kind || ': ' || detail AS reason, min(ord) AS ord FROM c_findings WHERE impact >= 5 AND confidence >= 0.7 GROUP BY ALL)) WHERE rank <= {K.REASON_LIMIT}"""
SQL["report_score"] = """
SELECT s.ext_id, report_score, CASE WHEN report_score IS NOT NULL AND p.ext_no % 3 = 0 THEN 'medium' ELSE report_level END AS report_level
FROM c_reportscore s JOIN c_packages p ON p.ext_id = s.ext_id"""

SQL["kept_api_calls"] = "SELECT ext_id, path, line, role, api, root FROM c_apicalls"
SQL["category_rules"] = "SELECT ext_id, risk, rule_id, count(*) AS hits FROM c_hits GROUP BY ext_id, risk, rule_id"
SQL["category_states"] = "SELECT ext_id, risk, state, rules FROM c_states"
SQL["category_order"] = "SELECT ext_id, row_number() OVER (PARTITION BY ext_id ORDER BY weight DESC, priority DESC) AS position, risk, state FROM c_states"
SQL["category_evidence"] = "SELECT ext_id, risk, text, rank FROM c_evidence"
SQL["category_places"] = f"""
SELECT ext_id, risk, path, line::BIGINT AS line, rule_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY ext_id, risk ORDER BY ord, rule_id) AS rank FROM (
  SELECT ext_id, risk, path, line, rule_id, min(ord) AS ord FROM c_hits GROUP BY ALL)) WHERE rank <= {K.HIT_LIMIT}"""
SQL["final_verdict"] = "SELECT * FROM c_verdict"
SQL["verdict_reasons"] = """
SELECT ext_id, rank, reason FROM (SELECT s.ext_id, v.lim, row_number() OVER (PARTITION BY s.ext_id ORDER BY s.weight DESC, s.priority DESC) AS rank,
  s.title || ': ' || s.state || coalesce('. Evidence: ' || e.text, '') AS reason
FROM c_states s JOIN (SELECT ext_id, CASE WHEN verdict = 'malicious' OR level = 'high' THEN 5 WHEN verdict = 'suspicious' THEN 4 ELSE 3 END AS lim FROM c_verdict) v ON v.ext_id = s.ext_id
LEFT JOIN c_evidence e ON e.ext_id = s.ext_id AND e.risk = s.risk AND e.rank = 1
WHERE CASE WHEN v.lim = 5 THEN s.state IN ('critical', 'suspicious') ELSE s.state IN ('suspicious', 'capability') END) WHERE rank <= lim"""
SQL["risk_answers"] = "SELECT * FROM c_answers"
SQL["verdict_sentence"] = "SELECT * FROM c_sentence"


def _norm_detail(d: str) -> str:
    short = f"regexp_replace({d}, '(\\.value)(\\.value)+', '.value', 'g')"
    return (f"replace(replace({short}, 'sensitive API source chrome.storage.session.get.value', 'data read from session storage'), "
            f"'DOM selection via document.querySelector', 'page data read by selector')")


_SRC = f"""CASE WHEN {m('detail', K.SESSION_SOURCE)} THEN 'session-or-credential-data' WHEN {m('detail', K.PAGE_SOURCE)} THEN 'page-data'
  ELSE {_norm_detail("string_split(detail, ' -> ')[1]")} END"""
_SNK = f"""CASE WHEN {m('detail', K.NETWORK_SINK)} THEN 'network' WHEN {m('detail', K.MESSAGE_SINK)} THEN 'extension-message'
  ELSE {_norm_detail("string_split(detail, ' -> ')[-1]")} END"""
_KEY = f"""CASE WHEN kind = 'data_flow' THEN 'flow:' || role || ':' || {_SRC} || ':' || {_SNK} WHEN kind = 'cookie_read' THEN kind || ':' || role || ':document.cookie'
  WHEN kind = 'storage_read' THEN kind || ':' || role WHEN kind IN ('unresolved_dependency', 'orphan_file', 'minified') THEN kind || ':' || detail
  WHEN kind = 'risky_call' THEN kind || ':' || string_split(detail, ':')[1] ELSE kind || ':' || path || ':' || detail END"""
_PRIO = f"""(SELECT priority FROM c_kind k WHERE k.kind = f.kind) + CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 0 END + round(confidence * 10)::INT"""
_LABEL = case([(f"role = {q(r)}", q(t)) for r, t in K.ROLE_LABELS], "role")
_SENTENCE = f"""'In the ' || {_LABEL} || ' (' || path || ', line ' || line || ') we found ' || {case([(f"kind = {q(k)}", q(n)) for k, n in K.KIND_NOUNS], 'kind')} || ': ' ||
  {_norm_detail('detail')} || '. ' || {case([(f"kind = {q(k)}", q(t)) for k, _, t in K.KIND_REASONS])} || ' Confidence: ' || round(confidence * 100)::INT || '%.'"""
_GROUPED = f"""
SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY priority DESC, ord) AS rank FROM (SELECT * EXCLUDE (rn) FROM (
  SELECT *, count(*) OVER (PARTITION BY ext_id, group_key) AS occurrences, row_number() OVER (PARTITION BY ext_id, group_key ORDER BY priority DESC, ord) AS rn
  FROM (SELECT *, {_KEY} AS group_key, {_PRIO} AS priority FROM c_confirmed f)) WHERE rn = 1)"""
SQL["narratives"] = f"""
SELECT ext_id, rank, group_key, occurrences, priority::BIGINT AS priority, {_SENTENCE} || CASE WHEN occurrences > 1 THEN ' Similar places: ' || (occurrences - 1) || '.' ELSE '' END AS narrative
FROM ({_GROUPED}) WHERE rank <= {K.NARRATIVE_LIMIT}"""
SQL["narratives_omitted"] = f"SELECT ext_id, coalesce(sum(occurrences) FILTER (WHERE rank > {K.NARRATIVE_LIMIT}), 0)::BIGINT AS omitted FROM ({_GROUPED}) GROUP BY ext_id"
SQL["domain_narratives"] = f"""
SELECT ext_id, rank, domain, 'In the ' || {_LABEL} || ' (' || path || ', line ' || line || ') we found the domain ' || domain || ', ' ||
  CASE WHEN kind = 'host_permission' THEN 'declared as host permission' ELSE 'contacted by code' END || ', classed as ' || category || '.' AS narrative
FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY priority, ord, domain, kind) AS rank FROM c_domainfindings) WHERE rank <= {K.DOMAIN_LIMIT}"""
_REVIEW = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY confidence DESC, ord) AS rank FROM (SELECT * FROM (
  SELECT *, count(*) OVER (PARTITION BY ext_id, kind, role, g) AS occurrences, row_number() OVER (PARTITION BY ext_id, kind, role, g ORDER BY confidence DESC, ord) AS rn
  FROM (SELECT *, CASE WHEN kind = 'cookie_read' THEN 'document.cookie' ELSE detail END AS g FROM c_findings WHERE confidence >= {K.REVIEW_MIN_CONFIDENCE})) WHERE rn = 1)) WHERE rank <= {K.REVIEW_FINDINGS}"""
SQL["review_findings"] = f"SELECT ext_id, rank, kind, role, path, line::BIGINT AS line, detail, occurrences, confidence FROM ({_REVIEW})"
_RELEVANCE = f"""
  CASE WHEN EXISTS (SELECT 1 FROM c_findings n WHERE n.ext_id = f.ext_id AND n.path = f.path) THEN 10 ELSE 0 END
  + CASE WHEN role IN ('content_script', 'background', 'service_worker', 'options_ui', 'devtools', 'override_page', 'sandbox', 'side_panel', 'popup') THEN 5 ELSE 0 END
  + CASE WHEN is_obfuscated THEN 8 ELSE 0 END + CASE WHEN role = 'unknown' THEN 1 ELSE 0 END + CASE WHEN {m('path', S.INJECTOR_DIR)} THEN 7 ELSE 0 END
  - CASE WHEN is_minified THEN 8 ELSE 0 END + CASE WHEN line_count > 1000 THEN -5 WHEN line_count < 100 THEN 3 ELSE 0 END"""
SQL["source_budget"] = f"""
SELECT *, least(size, {K.SOURCE_BUDGET} - before)::BIGINT AS taken FROM (
  SELECT *, (sum(size) OVER (PARTITION BY ext_id ORDER BY relevance DESC, path ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM (
    SELECT ext_id, path, role, ({_RELEVANCE})::BIGINT AS relevance, len(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) AS size
    FROM c_files f WHERE role <> 'library' AND code IS NOT NULL) WHERE size > 0) WHERE before < {K.SOURCE_BUDGET}"""
SQL["evidence_lines"] = f"""
SELECT ext_id, 'package' AS section, '0' AS seq, name AS fact FROM c_manifests UNION ALL SELECT ext_id, 'finding', rank::VARCHAR, detail FROM ({_REVIEW})
UNION ALL SELECT ext_id, 'entity', entity, category FROM ({SQL['entity_summary']})
UNION ALL SELECT DISTINCT ext_id, CASE WHEN category IN ('own', 'infrastructure') THEN 'own_domain' ELSE 'other_domain' END, domain, category FROM c_domainfindings"""
SQL["report_documents"] = """
SELECT v.ext_id, v.verdict, v.level, s.report_score, s.report_level, t.summary FROM c_verdict v JOIN c_reportscore s ON s.ext_id = v.ext_id JOIN c_sentence t ON t.ext_id = v.ext_id"""
_QUESTIONS = [n for n, _ in C.ANSWERS] + ["can_spy_unnoticed"]
SQL["report_sections"] = f"""
SELECT ext_id, 'package' AS section, 1::BIGINT AS seq, name, ext_version AS text FROM c_manifests
UNION ALL SELECT ext_id, 'verdict', 1, verdict, level FROM c_verdict
UNION ALL SELECT ext_id, 'summary', 1, 'summary', summary FROM c_sentence
UNION ALL SELECT ext_id, 'score', 1, report_level, report_score::DECIMAL(20, 1)::VARCHAR FROM c_reportscore
UNION ALL SELECT ext_id, 'answer', list_position({qlist(_QUESTIONS)}, question), question, answer FROM (UNPIVOT c_answers ON {", ".join(_QUESTIONS)} INTO NAME question VALUE answer)
UNION ALL SELECT ext_id, 'category', row_number() OVER (PARTITION BY ext_id ORDER BY weight DESC, priority DESC), risk, state FROM c_states
UNION ALL SELECT ext_id, 'narrative', rank, group_key, narrative FROM ({SQL['narratives']})
UNION ALL SELECT ext_id, 'domain', rank, domain, narrative FROM ({SQL['domain_narratives']})
UNION ALL SELECT ext_id, 'finding', row_number() OVER (PARTITION BY ext_id ORDER BY path, line, kind, detail, ord), kind, path || ':' || line || ' ' || detail FROM c_confirmed
UNION ALL SELECT ext_id, 'permission', row_number() OVER (PARTITION BY ext_id ORDER BY permission), permission, description FROM ({_UNUSED})"""
SQL["reason_translation"] = f"""
SELECT DISTINCT kind, detail, {case([(f"kind = {q(k)}", q(t)) for k, _, t in K.KIND_REASONS])} AS reader_reason, {_norm_detail('detail')} AS plain_detail FROM c_verdicted"""
SQL["review_parsing"] = r"""
SELECT conv_id, turn, 'Turn ' || turn AS purpose, CASE conv_id % 5 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'suspicious' END AS review_verdict,
  CASE WHEN conv_id % 5 < 2 THEN 'high' WHEN conv_id % 5 = 3 THEN 'critical' ELSE 'medium' END AS review_level,
  CASE WHEN conv_id % 5 <> 4 THEN 'yes' END AS log_keys, CASE WHEN conv_id % 5 <> 4 THEN 'possible' END AS hidden_code, CASE WHEN conv_id % 5 <> 4 THEN 'no' END AS other,
  md5(n) AS narrative_md5, len(n) AS narrative_length
FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    '# Title' || chr(10) || '**bold** and `code`' || chr(10) || '- item' || chr(10) || text,
    '\*{1,3}([^*]+)\*{1,3}', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '(?m)^[-*]\s+', '', 'g'), '(?m)^>\s+', '', 'g'), '`{1,3}[^`]*`{1,3}', '', 'g'), '(?m)^-{3,}$', '', 'g'),
    '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS n FROM conversations)"""
SQL["json_recovery"] = "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events"

_N = "regexp_extract(ext_id, '([0-9]+)$', 1)::BIGINT"
_JOBS = "(SELECT user_id AS n, arg_max(event_type, (ts, event_id)) AS event, round(sum(value), 3) AS duration_s FROM events GROUP BY user_id)"
_METRICS = f"""
SELECT p.ext_id, coalesce(f.n_confirmed, 0) AS n_confirmed, coalesce(f.n_critical_findings, 0) AS n_critical_findings, coalesce(f.n_high_findings, 0) AS n_high_findings,
  coalesce(f.n_medium_findings, 0) AS n_medium_findings, coalesce(f.n_low_findings, 0) AS n_low_findings, c.* EXCLUDE (ext_id), v.verdict, v.level, a.* EXCLUDE (ext_id),
  coalesce(d.n_sensitive_domains, 0) AS n_sensitive_domains, coalesce(d.n_unknown_domains, 0) AS n_unknown_domains, coalesce(d.sensitive_list, '') AS sensitive_list,
  coalesce(u.n_unused, 0) AS n_unused, coalesce(u.n_unused_high, 0) AS n_unused_high, coalesce(u.unused_list, '') AS unused_list, s.report_score, s.report_level,
  CASE WHEN j.event = 'error' THEN 'failed' ELSE 'completed' END AS status, coalesce(j.duration_s, 0) AS duration_s, p.ext_no // 10 + 1 AS batch
FROM c_packages p LEFT JOIN {_JOBS} j ON j.n = p.ext_no LEFT JOIN (SELECT ext_id, count(*) AS n_confirmed, {', '.join(f"count(*) FILTER (WHERE severity = {q(s)}) AS n_{s}_findings" for s in ('critical', 'high', 'medium', 'low'))} FROM c_confirmed GROUP BY ext_id) f ON f.ext_id = p.ext_id
LEFT JOIN (SELECT ext_id, {', '.join(f"max(state) FILTER (WHERE risk = {q(c[0])}) AS cat_{c[0]}" for c in C.CATEGORIES)} FROM c_states GROUP BY ext_id) c ON c.ext_id = p.ext_id
LEFT JOIN c_verdict v ON v.ext_id = p.ext_id LEFT JOIN c_answers a ON a.ext_id = p.ext_id
LEFT JOIN (SELECT ext_id, count(*) FILTER (WHERE category <> 'unknown') AS n_sensitive_domains, count(*) FILTER (WHERE category = 'unknown') AS n_unknown_domains,
  array_to_string(list_sort(list_distinct(list(domain) FILTER (WHERE category <> 'unknown')))[1:5], ', ') AS sensitive_list FROM c_domainfindings GROUP BY ext_id) d ON d.ext_id = p.ext_id
LEFT JOIN (SELECT ext_id, count(*) AS n_unused, count(*) FILTER (WHERE category IN ('critical', 'high')) AS n_unused_high,
  array_to_string(list_sort(list_distinct(list(permission)))[1:8], ', ') AS unused_list FROM ({_UNUSED}) GROUP BY ext_id) u ON u.ext_id = p.ext_id
LEFT JOIN c_reportscore s ON s.ext_id = p.ext_id"""
SQL["batch_metrics"] = _METRICS
SQL["batch_summary"] = f"""
SELECT batch, count(*) AS total, count(*) FILTER (WHERE done) AS completed, count(*) FILTER (WHERE NOT done) AS failed, round(avg(d) FILTER (WHERE done), 1) AS mean_duration_s
FROM (SELECT ext_no // 10 + 1 AS batch, coalesce(event, '') <> 'error' AS done, coalesce(duration_s, 0) AS d FROM c_packages LEFT JOIN {_JOBS} ON n = ext_no) GROUP BY ROLLUP (batch)"""
SQL["verdict_distribution"] = f"SELECT batch, verdict, level, count(*) AS n FROM (SELECT *, {_N} // 10 + 1 AS batch FROM c_verdict) GROUP BY ROLLUP (batch, verdict, level)"
SQL["category_cross_table"] = "SELECT risk, " + ", ".join(f"count(*) FILTER (WHERE state = {q(s)}) AS n_{s}" for s in ("critical", "suspicious", "capability", "none")) + ", count(*) AS n_total FROM c_states GROUP BY risk"
SQL["answer_cross_table"] = "SELECT answer, " + ", ".join(f"count(*) FILTER (WHERE value = {q(s)}) AS n_{s}" for s in ("yes", "possible", "no")) + (
    ", count(*) AS n_total FROM (UNPIVOT c_answers ON COLUMNS(* EXCLUDE (ext_id)) INTO NAME answer VALUE value) GROUP BY answer")
SQL["finding_totals"] = f"""
SELECT count(*) AS packages, sum(n_critical_findings)::BIGINT AS critical, sum(n_high_findings)::BIGINT AS high, sum(n_medium_findings)::BIGINT AS medium, sum(n_low_findings)::BIGINT AS low,
  sum(n_unused)::BIGINT AS unused, sum(n_unused_high)::BIGINT AS unused_high, count(*) FILTER (WHERE n_unused > 0) AS with_unused, sum(n_sensitive_domains)::BIGINT AS sensitive_domains,
  sum(n_unknown_domains)::BIGINT AS unknown_domains FROM ({_METRICS})"""
SQL["detection_rate"] = """
SELECT count(*) AS n, count(*) FILTER (WHERE t) AS n_positive, count(*) FILTER (WHERE f AND t) AS true_positive, count(*) FILTER (WHERE NOT f AND t) AS false_negative,
  count(*) FILTER (WHERE f AND NOT t) AS false_positive, count(*) FILTER (WHERE NOT f AND NOT t) AS true_negative, round(avg(f::INT::DOUBLE) FILTER (WHERE t), 6) AS detection_rate,
  round(avg((NOT f)::INT::DOUBLE) FILTER (WHERE t), 6) AS false_negative_rate
FROM (SELECT v.verdict = 'malicious' AS f, l.toxic = 1 AS t FROM labels l JOIN c_verdict v ON v.ext_id = 'ext-' || (l.doc_id // 20))"""
_FILE = "source || '/' || lpad(doc_id::VARCHAR, 9, '0')"
SQL["batch_numbers"] = f"SELECT file, position, position // 10 + 1 AS batch, position % 10 + 1 AS position_in_batch FROM (SELECT {_FILE} AS file, row_number() OVER (ORDER BY {_FILE}) - 1 AS position FROM documents)"
SQL["sorted_page"] = f"SELECT {_FILE} AS file FROM documents ORDER BY 1 LIMIT 10 OFFSET 20"
SQL["scored_order_lines"] = f"""
SELECT key, round(w, 4) AS weighted, round(w::DECIMAL(20, 6), 1)::DOUBLE AS score, {level('round(w::DECIMAL(20, 6), 1)', K.AUDIT_LEVELS)} AS level FROM (
  SELECT l_suppkey AS key, sum(l_quantity / 10 * ({band('l_discount * 10')})) AS w FROM lineitem GROUP BY l_suppkey)"""
SQL["top_order_lines"] = """
SELECT l_suppkey, rank, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, n - 5 + greatest(5 - n, 0) AS omitted, round(total - shown, 2) AS omitted_total FROM (
  SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n, sum(l_extendedprice) OVER (PARTITION BY l_suppkey) AS total, sum(CASE WHEN rank <= 5 THEN l_extendedprice END) OVER (PARTITION BY l_suppkey) AS shown
  FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)) WHERE rank <= 5"""

_REP = """(SELECT 'd' || user_id || '.example.net' AS domain, event_type AS provider, ts AS queried_at, event_id % 3 AS malicious, event_id % 5 AS suspicious,
  event_id % 70 AS harmless, event_id % 11 AS undetected, value, event_id FROM events)"""
SQL["reputation_scores"] = f"""
SELECT domain, round(score, 6) AS score, provider, is_malicious FROM (SELECT domain, max(score) AS score, arg_max(provider, (score, provider)) AS provider, bool_or(is_malicious) AS is_malicious FROM (
  SELECT domain, 'engines' AS provider, CASE WHEN malicious + suspicious + harmless + undetected > 0 THEN (malicious + suspicious) / (malicious + suspicious + harmless + undetected) ELSE 0.0 END AS score,
    malicious > 0 OR suspicious > 2 AS is_malicious FROM {_REP}
  UNION ALL SELECT domain, 'scans', count(*) FILTER (WHERE malicious > 1) / count(*), count(*) FILTER (WHERE malicious > 1) > 0 FROM {_REP} GROUP BY domain
  UNION ALL SELECT domain, 'abuse', least(value, 100.0) / 100, least(value, 100.0) / 100 > 0.5 FROM {_REP}) GROUP BY domain)"""
SQL["reputation_cache"] = f"""
SELECT w.domain, count(c.provider) AS n, count(c.provider) > 0 AS cached FROM (SELECT DISTINCT 'd' || c_custkey || '.example.net' AS domain FROM customer) w
LEFT JOIN (SELECT domain, provider FROM {_REP} GROUP BY ALL HAVING max(queried_at) + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-20') c ON c.domain = w.domain GROUP BY w.domain"""
SQL["lookup_caps"] = f"""
SELECT job, domain, rank, rank <= {K.PROVIDER_CAP} AS for_provider FROM (SELECT job, domain, row_number() OVER (PARTITION BY job ORDER BY domain) AS rank
  FROM (SELECT DISTINCT event_type AS job, user_id AS domain FROM events)) WHERE rank <= {K.LOOKUP_CAP}"""
SQL["report_retention"] = """
SELECT o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 12 MONTH AS purged, count(*) AS n, count(DISTINCT sha256(o_orderkey::VARCHAR)) AS hashes FROM orders GROUP BY 1"""
SQL["cache_purge"] = f"""
SELECT provider, count(*) AS n, count(DISTINCT domain) AS domains FROM {_REP} WHERE queried_at + INTERVAL 86400 SECOND >= TIMESTAMP '2024-01-20' GROUP BY provider"""
_STATES = qlist([s for s, _ in K.PROGRESS_ROWS])
SQL["latest_job_status"] = f"""
SELECT job_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, n_events,
  {case([(f"status = {q(s)}", str(p)) for s, p in K.PROGRESS_ROWS], '0')}::BIGINT AS progress FROM (
  SELECT user_id AS job_id, arg_max({_STATES}[event_id % {len(K.PROGRESS_ROWS)} + 1], (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events
  FROM events GROUP BY user_id)"""
SQL["stored_job_status"] = SQL["latest_job_status"]
SQL["reputation_timeline"] = f"""
WITH e AS (SELECT domain, provider, t, lag(t) OVER w AS p, lead(t) OVER w AS n
  FROM (SELECT *, epoch_us(queried_at) // 1000 AS t FROM {_REP}) WINDOW w AS (PARTITION BY domain, provider ORDER BY queried_at))
SELECT domain, provider, CASE WHEN p IS NULL OR t >= p + 86400000 THEN 'stored' ELSE 'renewed' END AS kind, t AS at FROM e
UNION ALL SELECT domain, provider, 'expired', t + 86400000 FROM e WHERE coalesce(n >= t + 86400000, t + 86400000 < (SELECT max(t) - 3600000 FROM e))"""
SQL["id_checks"] = r"""
SELECT regexp_matches(e, '^[a-z]{32}$') AS valid_ext, regexp_matches(j, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS valid_job,
  regexp_matches(f, '(?i)\.(crx|zip)$') AS valid_file, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 4 = 0 THEN upper(l) ELSE l END AS e, CASE WHEN o_orderkey % 4 = 1 THEN u || '0' ELSE u END AS j,
    'pack' || o_orderkey || CASE o_orderkey % 4 WHEN 2 THEN '.tar' WHEN 3 THEN '.ZIP' ELSE '.crx' END AS f
  FROM (SELECT o_orderkey, translate(d, '0123456789', 'ghijklmnop') AS l, d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] AS u
    FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS d FROM orders))) GROUP BY ALL"""
_CLOCK = "floor(epoch_us(ts) / 600000000)::BIGINT"
SQL["request_limits"] = f"""
SELECT {_CLOCK} // 10 * 10 AS window_start, event_type AS client, count(*) AS requests, '10 seconds' AS duration FROM events GROUP BY ALL HAVING count(*) > 5
UNION ALL SELECT {_CLOCK} // 60 * 60, event_type, count(*), '60 seconds' FROM events GROUP BY ALL HAVING count(*) > 20"""
SQL["streamed_request_limits"] = f"SELECT {_CLOCK} // 60 * 60 AS window_start, event_type AS client, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 20"
SQL["visit_priorities"] = f"""
SELECT category, min(priority)::BIGINT AS priority, bool_or(category IN {inlist(D.SENSITIVE)}) AS sensitive, count(DISTINCT domain) AS n_domains FROM c_domainfindings GROUP BY category"""

SQL = {name: build(sql) for name, sql in SQL.items()}

