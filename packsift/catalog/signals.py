r"""Text signals. Patterns use the syntax common to Java and RE2; ``\b`` is the
ASCII word edge (see ``functions.text.js``)."""

# --- fixed values: raw-text signals (label, severity, pattern, permission root) --
GREP_SIGNALS = [
    ("XHR prototype hook", "critical", r"XMLHttpRequest\.prototype\.(open|send|setRequestHeader)\s*=", None),
    ("window.fetch replacement", "critical", r"\bfetch\s*=\s*(?:async\s+)?function", None),
    ("chrome.management.getAll()", "high", r"chrome\.management\.getAll\s*\(", "management"),
    ("chrome.management.setEnabled()", "high", r"chrome\.management\.setEnabled\s*\(", "management"),
    ("Geolocation API hook", "high", r"navigator\.geolocation\.(getCurrentPosition|watchPosition)\s*=", None),
    ("History API hook", "high", r"history\.(pushState|replaceState)\s*=", None),
    ("Hardcoded apiSecret", "high", r"apiSecret\s*:\s*[\"'][A-Za-z0-9_\-]{8,}[\"']", None),
    ("Hardcoded api_secret", "high", r"api_secret\s*[:=]\s*[\"'][A-Za-z0-9_\-]{8,}[\"']", None),
    ("Google Analytics 4 measurement id", "medium", r"[\"']G-[A-Z0-9]{8,}[\"']", None),
    ("Data sharing flags", "high", r"ecommerceEnabled|clickstreamEnabled|advertisementEnabled", None),
    ("E-commerce tracking events", "high", r"ECOMMERCE_TRACK|ECOMMERCE_HEART_BEAT|ECOMMERCE_SYNC_UP", None),
    ("DataSharingTypes in code", "high", r"DataSharingTypes\.(ecommerce|clickstream|advertisement)", None),
    ("Panelist persistent id", "high", r"(?i)panalyticsId|panelist_?id", None),
    ("BIS/PANELOS framework", "high", r"bis_data|PANELOS_MESSAGE|posdMessageId", None),
    ("Shopify detection tracking", "high", r"SHOPIFY_DETECTED|ECOMMERCE_INIT_SHOPIFY|globalThis\.Shopify", None),
    ("Residential proxy network", "high", r"geosurf\.io|luminati\.io|brightdata\.com|oxylabs\.io", None),
    ("tab.url read", "medium", r"tab\??\.url\b", None),
    ("response.clone() read", "medium", r"response\.clone\s*\(\)", None),
    ("Dynamic script element", "high", r"document\.createElement\s*\(\s*[\"']script[\"']\s*\)", None),
    ("new Function()", "critical", r"\bnew\s+Function\s*\(", None),
    ("Social media platform domain", "medium", r"(?i)\b(?:facebook|tiktok|twitter|x\.com|linkedin|pinterest|youtube|instagram|snapchat|reddit|twitch)\.com\b", None),
    ("response.clone() interception", "high", r"response\.clone\s*\(\)", None),
    ("Ad platform fields (sponsored/adUnitId/campaignId)", "high", r"\b(?:sponsored|ad_unit_id|adUnitId|adUnitCode|campaignId|impressionId|adId)\b", None),
    ("chrome.proxy.settings", "high", r"chrome\.proxy\.settings", "proxy"),
    ("chrome.webRequest.onBefore*", "high", r"chrome\.webRequest\.onBefore(?:Request|SendHeaders)\b", "webRequest"),
    ("chrome.webRequest.onCompleted", "medium", r"chrome\.webRequest\.onCompleted\b", "webRequest"),
    ("chrome.scripting.executeScript()", "high", r"chrome\.scripting\.executeScript\s*\(", "scripting"),
    ("chrome.scripting.insertCSS()", "medium", r"chrome\.scripting\.insertCSS\s*\(", "scripting"),
    ("chrome.webNavigation.onCommitted", "medium", r"chrome\.webNavigation\.onCommitted\b", "webNavigation"),
    ("chrome.webNavigation.onCompleted", "medium", r"chrome\.webNavigation\.onCompleted\b", "webNavigation"),
    ("chrome.offscreen.createDocument()", "medium", r"chrome\.offscreen\.createDocument\s*\(", "offscreen"),
    ("chrome.alarms.create()", "medium", r"chrome\.alarms\.create\s*\(", "alarms"),
    ("chrome.cookies.get/getAll()", "high", r"chrome\.cookies\.get(?:All)?\s*\(", "cookies"),
    ("chrome.tabs API", "medium", r"chrome\.tabs\.(?:query|get|update|create)\s*\(", None),
    ("chrome.downloads.download()", "high", r"chrome\.downloads\.download\s*\(", "downloads"),
    ("chrome.history API", "high", r"chrome\.history\.(?:search|getVisits)\s*\(", None),
    ("chrome.privacy API", "high", r"chrome\.privacy\.(?:network|services|websites)\b", None),
    ("chrome.webRequestAuthProvider", "high", r"chrome\.webRequestAuthProvider\b", None),
]
HOOK_SIGNALS = ["XHR prototype hook", "window.fetch replacement"]

# --- fixed values: obfuscation indicators, summed over the file ------------------
OBFUSCATION_INDICATORS = [
    r"atob\s*\(", r"eval\s*\(", r"\\x[0-9a-fA-F]{2}", r"\\u[0-9a-fA-F]{4}",
    r"String\.fromCharCode", r"\['\\x", r"\[_0x[a-f0-9]+\]", r"_0x[a-f0-9]{4,}",
    r"var\s+_0x",
]
OBFUSCATION_LIMIT = 5

# --- fixed values: minification thresholds ----------------------------------------
MAX_LINE = 5000
MAX_HEX_ESCAPES = 100
ENTROPY_MIN_SAMPLE = 500
ENTROPY_LIMIT = 6.5
SHORT_LONG_RATIO = 0.8
HEX_ESCAPE = r"\\x[0-9a-fA-F]{2}"
SHORT_ASSIGN = r"\b[a-z_][a-z_]?\s*="
LONG_WORD = r"\w{4,}"

# --- fixed values: usage flags ------------------------------------------------------
USES_FETCH = r"\bfetch\s*\("
USES_XHR = r"\bnew\s+XMLHttpRequest\b"
USES_EVAL = r"\beval\s*\("
USES_DOM_WRITE = r"\.(innerHTML|outerHTML|innerText|textContent)\s*="

# --- fixed values: URL, domain and API extraction -------------------------------------
# Repeats are over character classes only, so hostile text cannot exhaust the regex stack.
_HOST = r"[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9](?:[-a-zA-Z0-9.]*[-a-zA-Z0-9])?"
URL_IN_CODE = r"https?://" + _HOST + r"(?:/[^\s'\"`,;)\]}>]*)?"
DYNAMIC_URL = r"\b(?:fetch|axios(?:\.\w+)?|XMLHttpRequest|WebSocket|EventSource|sendBeacon)\s*\([^)\n]*(?:\+|`|\$\{)"
URL_HOST = r"(?i)https?://(" + _HOST + ")"
BARE_HOST = r"(?i)['\"`]([a-zA-Z0-9][-a-zA-Z0-9]*\.(?:com|org|net|edu|gov|io|co|me|info|biz)(?:\.[a-z]{2,3})?)['\"`]"
API_REFERENCE = r"\bchrome\.([a-zA-Z](?:[a-zA-Z.]*[a-zA-Z])?)\s*(?:\(|\.)"
CONTEXT_CHARS = 240

# --- fixed values: dependency references ------------------------------------------------
LINE_DEPENDENCIES = [
    ("static_import", r"\bimport\s+[^'\"]+\s+from\s+['\"]([^'\"]+)['\"]"),
    ("static_import", r"\bimport\s*['\"]([^'\"]+)['\"]"),
    ("dynamic_import", r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("require", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("worker", r"\bnew\s+Worker\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("script_injection", r"\.src\s*=\s*['\"]([^'\"]+\.js[^'\"]*)['\"]"),
]
INJECTED_FILES = r"\bfiles\s*:\s*\[([^\]]*)\]"
QUOTED = r"['\"]([^'\"]+)['\"]"
HTML_SCRIPT = r"(?i)<script[^>]+src=['\"]([^'\"]+)['\"]"
HTML_SCRIPT_JS = r"(?i)<script[^>]+src=['\"]([^'\"]+\.(?:js|mjs))(?:\?[^'\"]*)?['\"]"
LOCAL_FILE = r"(?i)\.(js|mjs|cjs|jsx|html?|css|json)$"

# --- fixed values: file roles -----------------------------------------------------------
KNOWN_LIBRARIES = [
    "jquery", "lodash", "underscore", "html2canvas", "react.min", "vue.min",
    "angular.min", "bootstrap.min",
]
INJECTOR_FILE = r"/(executors?|injectors?|inject|hooks?|patches?|interceptors?)/[^/]+\.js$"
INJECTOR_DIR = r"(?i)/(executors?|injectors?|inject|hooks?|patches?|interceptors?)/"
RESOURCE_TYPES = [
    ("javascript", r"(?i)\.(js|mjs|cjs|jsx)$"), ("html", r"(?i)\.html?$"),
    ("json", r"(?i)\.json$"), ("css", r"(?i)\.css$"),
    ("archive", r"(?i)\.(zip|crx|xpi|7z|rar|tar|gz)$"),
]
SKIPPED_DIRS = r"(^|/)(node_modules|_metadata)/"

# --- fixed values: encoded literals ---------------------------------------------------------
BASE64_CALL = r"atob\s*\(\s*['\"]([A-Za-z0-9+/=]+)['\"]\s*\)"
CHAR_CODES = r"String\.fromCharCode\s*\(\s*([\d\s,]+)\)"
PRINTABLE = r"^[\x20-\x7E\r\n\t]+$"

# --- fixed values: credential words, first in list order wins ---------------------------------
LITERAL_WORDS = [
    "password", "bearer", "access_token", "refresh_token", "api_key", "apisecret",
    "api_secret", "client_secret", "secret_key", "signing_key", "auth_token", "x-api-key",
    "app_secret", "wallet", "seed phrase", "mnemonic", "privatekey", "metamask",
]
SELECTOR_WORDS = [
    "password", "token", "auth", "bearer", "access_token", "refresh_token", "wallet",
    "seed phrase", "mnemonic", "privatekey", "metamask",
]
CRITICAL_SELECTOR_WORDS = ["password", "privatekey", "seed phrase", "mnemonic"]

# --- fixed values: navigation reasons -----------------------------------------------------------
NAVIGATION_REASONS = [
    ("product identifier", r"(?i)\basin\b|product[-_ ]?id|productid|dp/"),
    ("current page/domain", r"(?i)location\.(hostname|host|href|origin)|document\.location|window\.location|\bdomain\b"),
    ("affiliate parameters", r"(?i)[?&](tag|ascsubtag|affiliate|affid|ref|utm_[a-z]+)=|affiliate|referral"),
    ("promotion domain", r"(?i)promo|promotion|lead|10xprofit|ecomstal"),
]
