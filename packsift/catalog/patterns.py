"""Code-pattern rules over call sites, members, assignments and listeners."""

# --- fixed values: sinks ---------------------------------------------------------
NETWORK_SINKS = [
    "fetch", "axios", "axios.get", "axios.post", "axios.put", "axios.patch",
    "axios.request", "navigator.sendBeacon", "XMLHttpRequest.send", "postMessage",
    "chrome.runtime.sendNativeMessage", "chrome.runtime.connect",
    "chrome.runtime.connectNative", "chrome.identity.launchWebAuthFlow",
    "navigator.serviceWorker.controller.postMessage",
]
MESSAGE_SINKS = ["chrome.runtime.sendMessage", "window.postMessage"]
CHANNEL_CONSTRUCTORS = ["WebSocket", "EventSource"]
SELECTOR_METHODS = [
    "document.querySelector", "document.querySelectorAll", "document.getElementById",
    "document.getElementsByClassName", "document.getElementsByTagName",
    "document.getElementsByName",
]
CREDENTIAL_SELECTOR_CALLS = r"querySelector|querySelectorAll|getElementById|getElementsByName"

# --- fixed values: (matcher, category, severity, object, name, first-argument text) --
_P = ["input[type=\"password\"]", "input[type=password]"]
PATTERN_ROWS = [
    ("call", "data_theft", "critical", None, "document.querySelector", _P),
    ("call", "data_theft", "critical", None, "document.querySelectorAll", _P),
    ("member", "data_theft", "high", "document", "forms", None),
    ("member", "data_theft", "high", None, "innerText", None),
    ("member", "data_theft", "high", None, "textContent", None),
    ("call", "data_theft", "high", None, "window.getSelection", None),
    ("member", "data_theft", "critical", "document", "cookie", None),
    ("call", "data_theft", "critical", None, "chrome.cookies.get", None),
    ("call", "data_theft", "critical", None, "chrome.cookies.getAll", None),
    ("listener", "keylogger", "critical", None, "keyup", None),
    ("listener", "keylogger", "critical", None, "keypress", None),
    ("listener", "keylogger", "critical", None, "keydown", None),
    ("listener", "keylogger", "high", None, "submit", None),
    ("listener", "keylogger", "medium", None, "input", None),
    ("listener", "keylogger", "medium", None, "change", None),
    ("call", "injection", "critical", None, "document.createElement", ["script"]),
    ("assignment", "injection", "medium", None, "innerHTML", None),
    ("call", "injection", "high", None, "document.write", None),
    ("call", "injection", "high", None, "document.writeln", None),
    ("call", "injection", "critical", None, "document.createElement", ["iframe"]),
    ("call", "injection", "high", None, "chrome.scripting.executeScript", None),
    ("call", "injection", "high", None, "chrome.tabs.executeScript", None),
    ("call", "evasion", "critical", None, "eval", None),
    ("call", "evasion", "medium", None, "console.clear", None),
    ("call", "evasion", "high", None, "chrome.management.getAll", None),
    ("call", "evasion", "high", None, "chrome.management.setEnabled", None),
    ("call", "evasion", "high", None, "chrome.management.uninstallSelf", None),
    ("call", "clipboard", "critical", None, "navigator.clipboard.readText", None),
    ("call", "clipboard", "critical", None, "navigator.clipboard.read", None),
    ("call", "clipboard", "high", None, "document.execCommand", ["paste"]),
    ("member", "fingerprinting", "medium", None, "toDataURL", None),
    ("member", "fingerprinting", "medium", None, "getImageData", None),
    ("call", "privacy_risk", "high", None, "RTCPeerConnection", None),
    ("call", "injection", "medium", None, "chrome.tabs.update", None),
    ("call", "dropper", "critical", None, "chrome.downloads.download", None),
    ("member", "evasion", "high", "WebAssembly", "instantiate", None),
    ("member", "evasion", "high", "WebAssembly", "compile", None),
    ("member", "evasion", "high", "WebAssembly", "instantiateStreaming", None),
    ("call", "evasion", "medium", None, "Worker", None),
    ("call", "evasion", "medium", None, "SharedWorker", None),
    ("call", "exfiltration", "medium", None, "fetch", None),
    ("call", "exfiltration", "medium", None, "XMLHttpRequest", None),
    ("member", "exfiltration", "medium", None, "XMLHttpRequest", None),
    ("call", "exfiltration", "critical", None, "navigator.sendBeacon", None),
    ("call", "persistence", "medium", None, "chrome.storage.local.set", None),
    ("call", "persistence", "medium", None, "chrome.storage.local.get", None),
    ("call", "persistence", "medium", None, "chrome.storage.sync.set", None),
    ("call", "persistence", "medium", None, "chrome.alarms.create", None),
    ("call", "persistence", "medium", None, "setInterval", None),
    ("member", "privacy_risk", "high", None, "ecommerceEnabled", None),
    ("member", "privacy_risk", "high", None, "clickstreamEnabled", None),
    ("member", "privacy_risk", "high", None, "advertisementEnabled", None),
    ("member", "privacy_risk", "high", "tab", "url", None),
    ("member", "injection", "high", None, "adId", None),
    ("member", "injection", "high", None, "adUnit", None),
    ("member", "injection", "high", None, "adUnitId", None),
    ("member", "injection", "high", None, "adUnitCode", None),
    ("member", "injection", "high", None, "campaignId", None),
    ("member", "injection", "high", None, "impressionId", None),
]

# --- fixed values: native API replacement (name, severity, confidence, target, needs function) --
HOOK_ROWS = [
    ("xhr_prototype_hook", "critical", 0.95, r"XMLHttpRequest\.prototype\.(open|send|setRequestHeader)$", False),
    ("fetch_hook", "critical", 0.94, r"\.(fetch)$", True),
    ("history_api_hook", "high", 0.85, r"history\.(pushState|replaceState)$", True),
    ("geolocation_api_spoof", "high", 0.92, r"navigator\.geolocation\.(getCurrentPosition|watchPosition|clearWatch)$", False),
]
SCRIPT_VALUE = r"(?i)\.js|https?://"

# --- fixed values: taint sources ------------------------------------------------------
DOM_SELECTION = r"querySelector|querySelectorAll|getElementById|getElementsBy"
SENSITIVE_API = (
    r"localStorage|getItem|sessionStorage|navigator\.clipboard|chrome\.storage|chrome\.cookies"
    r"|chrome\.history|chrome\.tabs\.query|chrome\.tabs\.captureVisibleTab|chrome\.identity"
    r"|chrome\.bookmarks|chrome\.downloads\.search|chrome\.management|chrome\.topSites"
    r"|chrome\.sessions|GetCookie|GetAllCookies|getCookie|getAllCookies"
)
SENSITIVE_MEMBER = (
    r"localStorage|sessionStorage|indexedDB|window\.location|navigator\.clipboard"
    r"|document\.forms|document\.documentElement|document\.body"
)
DOM_READ = r"\.(value|innerText|textContent)$"
PROMISE_SOURCE = (
    r"chrome\.cookies|chrome\.history|chrome\.tabs\.query|chrome\.tabs\.captureVisibleTab"
    r"|chrome\.storage|chrome\.identity|chrome\.bookmarks|chrome\.downloads\.search"
    r"|chrome\.management|chrome\.topSites|chrome\.sessions|chrome\.scripting\.executeScript"
)

# --- fixed values: detail tests used by correlation and filters --------------------------
SINK_DETAIL = r"fetch|sendBeacon|WebSocket|axios|XMLHttpRequest|EventSource"
EVAL_DETAIL = r"eval|new Function|setTimeout\(string\)|setInterval\(string\)"
PASSWORD_DETAIL = r"password|credential selector|credential string|credential template"
SECRET_DETAIL = (
    r"(?i)password|credential selector|credential string|credential template|wallet"
    r"|seed phrase|mnemonic|privatekey|metamask|bearer|access_token|refresh_token"
)
MESSAGE_DETAIL = r"extension message sink|chrome\.runtime\.sendMessage|window\.postMessage"
SCRIPT_INJECTION_DETAIL = r"script\.src|createElement.*script"

# Words that look like calls but are syntax.
KEYWORDS = ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "await",
            "async", "of", "in", "else", "do", "void", "delete", "throw", "case", "yield"]
