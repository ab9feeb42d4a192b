"""Finding kinds, correlation rules and scoring constants."""

# --- fixed values: finding kinds -------------------------------------------------
# kind, default severity (None: from the detail), category, default confidence,
# default impact (None: from detail or severity), narrative priority
KIND_ROWS = [
    ("permission_unused", "medium", "manifest", 0.75, None, 20),
    ("permission_risky", None, "manifest", 0.75, None, 30),
    ("api_use", "medium", "static", 0.75, None, 20),
    ("risky_call", "medium", "static", 0.75, None, 50),
    ("data_flow", "critical", "taint", 0.90, 10.0, 100),
    ("sensitive_navigation", "high", "privacy_navigation", 0.84, 6.0, 88),
    ("obfuscated", "high", "static", 0.75, None, 60),
    ("minified", "low", "normalization", 0.45, None, 6),
    ("orphan_file", "low", "normalization", 0.35, None, 8),
    ("nested_archive", "medium", "normalization", 0.75, None, 20),
    ("unresolved_dependency", "medium", "normalization", 0.35, None, 10),
    ("remote_script", "high", "static", 0.95, None, 90),
    ("input_listener", "medium", "static", 0.75, None, 85),
    ("dom_injection", "medium", "static", 0.75, None, 70),
    ("cookie_read", "medium", "static", 0.75, None, 80),
    ("storage_read", "medium", "static", 0.75, None, 75),
    ("api_hook", "critical", "static", 0.93, 9.0, 94),
    ("api_spoof", "high", "static", 0.90, 5.0, 93),
    ("correlation", "medium", "correlation", 0.88, None, 95),
    ("large_file_signal", "medium", "static", 0.75, None, 20),
]

# Why each kind matters: technical wording, and the wording shown to readers.
KIND_REASONS = [
    ("permission_unused", "Declared permission with no observed use.", "The permission is declared but we saw no code that uses it."),
    ("permission_risky", "Declared permission grants a sensitive capability.", "The permission is sensitive; alone it proves nothing, but it sets the context."),
    ("api_use", "Privileged API call.", "The code calls a privileged browser API."),
    ("risky_call", "Primitive often used for execution, messaging or exfiltration.", "The code uses a sensitive primitive; its weight depends on role, permissions and data flow."),
    ("data_flow", "Sensitive source reaches a network or messaging sink.", "Sensitive data was traced to a network or messaging exit."),
    ("sensitive_navigation", "Outbound navigation carries page, product or affiliate context.", "A link to a third party carries page, product or affiliate context."),
    ("obfuscated", "Obfuscation signals reduce auditability.", "The code is written in a way that hides what it does."),
    ("minified", "Minified file; dense lines can hide behaviour.", "The file is compressed, which is normal in production but harder to review."),
    ("orphan_file", "Script not reachable from the dependency graph.", "Nothing in the package refers to this script."),
    ("nested_archive", "Nested archive can hide a second payload.", "The package holds another archive, which may carry a second payload."),
    ("unresolved_dependency", "Referenced local file is missing.", "A local file is referenced but is not in the package."),
    ("remote_script", "Remotely hosted script is loaded.", "The extension loads program code from the Internet."),
    ("input_listener", "Input listener can capture credentials.", "Listening to keys or forms can capture credentials when combined with sending."),
    ("dom_injection", "Page or script injection.", "Changing the page can alter content, imitate forms or run more code."),
    ("cookie_read", "Cookie access can expose sessions.", "Cookies can hold session identifiers."),
    ("storage_read", "Browser storage often holds tokens and state.", "Browser storage can hold tokens, preferences or session state."),
    ("api_hook", "Native API replaced to intercept traffic.", "A native network function is replaced, so page traffic can be watched."),
    ("api_spoof", "Native API replaced to fake a capability.", "A native function is replaced to fake what the browser reports."),
    ("correlation", "Co-occurring signals raise the likelihood of abuse.", "Several signals appear together, which makes real abuse more likely."),
    ("large_file_signal", "Text signal in a file too large for full analysis.", "A risk signal was found in a very large file."),
]

# --- fixed values: confidence bands and levels ------------------------------------
CONFIRM_AT = 0.7
BAND_FULL = 0.85
BAND_HALF = 0.7
AUDIT_LEVELS = [(45, "critical"), (25, "high"), (12, "medium")]
REPORT_LEVELS = [(50, "critical"), (25, "high"), (10, "medium")]
DOMAIN_CAP = 12
REASON_LIMIT = 12
SEVERITY_BOOST = {"critical": 8, "high": 5, "medium": 2}
SEVERITY_IMPACT = {"critical": 7.0, "high": 5.0, "medium": 2.0}
UI_ROLES = ["popup", "options_ui", "side_panel", "devtools"]

# --- fixed values: context confidence (kind, role or *, sink y/n/*, confidence) -----
# First matching row wins.
CONTEXT_CONFIDENCE = [
    ("input_listener", "content_script", "y", 0.97),
    ("input_listener", "content_script", "*", 0.70),
    ("input_listener", "background", "*", 0.55),
    ("input_listener", "*", "*", 0.45),
    ("dom_injection", "content_script", "y", 0.92),
    ("dom_injection", "content_script", "*", 0.70),
    ("dom_injection", "*", "*", 0.55),
    ("cookie_read", "content_script", "y", 0.95),
    ("cookie_read", "background", "y", 0.85),
    ("cookie_read", "popup", "y", 0.55),
    ("cookie_read", "unknown", "*", 0.40),
    ("cookie_read", "*", "*", 0.50),
    ("storage_read", "*", "y", 0.80),
    ("storage_read", "*", "*", 0.45),
    ("obfuscated", "content_script", "*", 0.97),
    ("obfuscated", "background", "*", 0.90),
    ("obfuscated", "*", "*", 0.85),
    ("remote_script", "*", "*", 0.98),
    ("data_flow", "*", "*", 0.92),
    ("api_hook", "content_script", "*", 0.97),
    ("api_hook", "unknown", "*", 0.95),
    ("api_hook", "*", "*", 0.90),
    ("api_spoof", "*", "*", 0.92),
]

# --- fixed values: correlation rules ----------------------------------------------------
# rule, condition over the per-package flags, severity, confidence, detail, anchor flag.
# The anchor names the finding whose place the correlation reports (None: the manifest).
CORRELATION_RULES = [
    ("cor-A1", "cookie_with_sink", "critical", 0.96, "cookie access co-located with a network sink: session exfiltration pattern", "cookie_with_sink"),
    ("cor-A2", "listener_with_sink", "critical", 0.95, "keyboard listener and network sink in one file: keylogger pattern", "listener_with_sink"),
    ("cor-A3", "secret_with_sink AND NOT secret_in_popup", "critical", 0.96, "credential field access and network sink in one file: credential theft pattern", "secret_with_sink"),
    ("cor-A3-popup", "secret_with_sink AND secret_in_popup", "medium", 0.62, "credential value and network call in the popup: review account handling", "secret_with_sink"),
    ("cor-A4", "remote_script AND (secret OR cookie)", "critical", 0.94, "remote script with credential or cookie access", None),
    ("cor-A5", "obfuscated_with_sink", "critical", 0.93, "obfuscated content script with network sink: stealth exfiltration pattern", "obfuscated_with_sink"),
    ("cor-B1", "all_sites AND (p_webRequest OR p_webRequestBlocking) AND sink", "critical", 0.88, "<all_urls> with webRequest and network sink: traffic interception pipeline", None),
    ("cor-B2a", "(p_pageCapture OR p_desktopCapture) AND sink", "critical", 0.90, "screen-capture permission with network sink: page exfiltration risk", None),
    ("cor-B2b", "p_tabCapture AND sink", "critical", 0.50, "tabCapture permission with network sink: audio capture to verify", None),
    ("cor-B3", "p_nativeMessaging AND sink", "critical", 0.87, "nativeMessaging permission with network sink: bridge to a local program", None),
    ("cor-B4", "p_proxy OR p_vpnProvider", "high", 0.82, "proxy/vpnProvider permission: can redirect or inspect all traffic", None),
    ("cor-B5", "p_debugger AND sink", "critical", 0.88, "debugger permission with network sink", None),
    ("cor-B6", "p_clipboardRead AND sink_file", "critical", 0.90, "clipboardRead permission with network sink in one file: clipboard exfiltration risk", None),
    ("cor-B7", "p_history AND sink_file", "critical", 0.87, "history permission with network sink in one file: browsing history exfiltration risk", None),
    ("cor-B8", "obfuscation AND (p_webRequest OR p_webRequestBlocking OR p_declarativeNetRequest)", "critical", 0.86, "obfuscation with a network-rewriting permission: hidden injection or redirect pattern", None),
    ("cor-B9", "p_scripting AND suspicious_url", "critical", 0.84, "scripting permission with a suspicious URL", None),
    ("cor-B10", "flow AND all_sites", "critical", 0.92, "sensitive-data flow with <all_urls> host access", "flow"),
    ("cor-B11", "message_flow AND background_sink", "critical", 0.90, "sensitive data enters extension messaging and the background has a network sink: inter-file exfiltration path", "message_flow"),
    ("cor-C1", "(p_history OR p_tabs) AND dynamic_code", "high", 0.78, "history/tabs permission with dynamic code execution", "dynamic_code"),
    ("cor-C2", "p_cookies AND NOT cookie AND NOT sink", "medium", 0.60, "cookies permission without cookie read or sink", None),
    ("cor-C3", "no_ui AND all_sites", "high", 0.83, "content scripts on <all_urls> without any visible surface", None),
    ("cor-C4", "storage AND obfuscation", "critical", 0.78, "obfuscated storage access", "storage"),
    ("cor-C5", "page_injection AND suspicious_url", "critical", 0.82, "DOM injection in a content script with a suspicious external URL", "page_injection"),
    ("cor-C6", "obfuscation AND dynamic_code", "critical", 0.85, "obfuscation with runtime code execution", "dynamic_code"),
    ("cor-C7", "n_secrets >= 2", "high", 0.80, "several credential-related signals in code", "any_secret"),
    ("cor-C8", "ip_or_tld_url", "high", 0.80, "code references a raw IP or uncommon TLD", None),
    ("cor-D1", "hook AND (p_proxy OR p_webRequest OR p_webRequestBlocking)", "critical", 0.96, "API interception with proxy/webRequest permission: traffic surveillance pipeline", "hook"),
    ("cor-D2", "n_script_injections >= 3", "critical", 0.94, "three or more script injection points", "script_injection"),
    ("cor-D3", "spoof AND p_proxy", "high", 0.90, "geolocation API replacement with proxy permission: location masking", "spoof"),
    ("cor-D4", "hook AND cookie", "critical", 0.95, "API interception with cookie access: traffic and session tokens exposed", "hook"),
    ("cor-legacy", "(p_cookies OR all_sites) AND external_url AND sink AND NOT cookie", "critical", 0.85, "cookies/<all_urls> permission with external domain and network sink: possible exfiltration path", None),
    ("cor-E1", "hook AND n_platforms >= 2", "critical", 0.93, "ad injection framework: XHR/fetch hooks next to social platform traces", "hook"),
]
CORRELATION_PERMISSIONS = [
    "webRequest", "webRequestBlocking", "pageCapture", "desktopCapture", "tabCapture",
    "nativeMessaging", "proxy", "vpnProvider", "debugger", "clipboardRead", "history",
    "declarativeNetRequest", "scripting", "tabs", "cookies",
]

# --- fixed values: job states and progress -------------------------------------------------
PROGRESS_ROWS = [
    ("queued", 5), ("downloading", 15), ("preprocessing", 25), ("ai_analysis", 38),
    ("static_analysis", 50), ("threat_intel", 85), ("generating_report", 92),
    ("completed", 100), ("failed", 0),
]

# --- fixed values: report limits --------------------------------------------------------------
NARRATIVE_LIMIT = 12
DOMAIN_LIMIT = 5
REVIEW_FINDINGS = 15
REVIEW_MIN_CONFIDENCE = 0.5
HIT_LIMIT = 20
EVIDENCE_LIMIT = 5
SOURCE_BUDGET = 3000
LOOKUP_CAP = 30
PROVIDER_CAP = 8
RETENTION_MONTHS = 12
CACHE_TTL_SECONDS = 86400
RATE_LIMITS = [("10 seconds", 5), ("60 seconds", 20)]

ROLE_LABELS = [
    ("content_script", "content script"), ("background", "background"),
    ("service_worker", "service worker"), ("popup", "popup"), ("options_ui", "options page"),
    ("devtools", "devtools page"), ("sandbox", "sandbox page"),
    ("override_page", "override page"), ("side_panel", "side panel"),
    ("library", "library"), ("unknown", "file"), ("manifest", "manifest"),
]

# --- fixed values: flow source and sink tests ---------------------------------------------
SESSION_SOURCE = r"(?i)password|credential|token|bearer|cookie|sessionStorage|localStorage|chrome\.storage"
PAGE_SOURCE = r"(?i)document\.querySelector|DOM selection|innerText|textContent|document\.body|document\.forms"
NETWORK_SINK = r"(?i)fetch|XMLHttpRequest|sendBeacon|WebSocket|axios|network sink"
MESSAGE_SINK = r"(?i)chrome\.runtime\.sendMessage|window\.postMessage|extension message"

# --- fixed values: what each kind is called in a narrative.
KIND_NOUNS = [
    ("data_flow", "data leaving for an exit"), ("sensitive_navigation", "an outbound link with context"),
    ("cookie_read", "cookie access"), ("storage_read", "browser storage access"),
    ("input_listener", "an input listener"), ("dom_injection", "page or script injection"),
    ("risky_call", "a sensitive call"), ("permission_risky", "a sensitive permission"),
    ("permission_unused", "an unused permission"), ("obfuscated", "obfuscated code"), ("minified", "minified code"),
    ("correlation", "a combination of signals"), ("api_hook", "a replaced native API"),
    ("api_spoof", "a faked native API"), ("remote_script", "a remote script"), ("orphan_file", "an unreferenced script"),
    ("unresolved_dependency", "a missing dependency"), ("nested_archive", "a nested archive"),
    ("large_file_signal", "a signal in a large file"),
]
