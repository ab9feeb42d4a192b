"""Permission catalogue."""

# --- fixed values: weight per risk category ---------------------------------
CATEGORY_WEIGHT = {"critical": 10, "high": 5, "medium": 2, "low": 1}

# --- fixed values: permission -> risk category ------------------------------
CRITICAL = ["tabCapture", "pageCapture", "debugger", "nativeMessaging", "proxy", "vpnProvider"]
HIGH = [
    "cookies", "scripting", "declarativeNetRequest", "webRequest", "webRequestBlocking",
    "userScripts", "declarativeNetRequestWithHostAccess", "desktopCapture", "history",
    "downloads", "downloads.open", "privacy", "browsingData", "contentSettings",
    "webNavigation", "webAuthenticationProxy", "webRequestAuthProvider",
    "certificateProvider", "platformKeys", "management",
]
MEDIUM = [
    "activeTab", "alarms", "bookmarks", "clipboardRead", "clipboardWrite", "geolocation",
    "identity", "identity.email", "sessions", "topSites", "contextMenus", "tabGroups",
    "dns", "tabs", "offscreen", "processes",
]
LOW = [
    "storage", "unlimitedStorage", "notifications", "idle", "power", "tts", "ttsEngine",
    "fontSettings", "declarativeContent", "gcm", "sidePanel", "search", "favicon",
    "readingList", "printing", "printingMetrics", "documentScan", "loginState",
    "accessibilityFeatures.modify", "accessibilityFeatures.read", "background",
    "declarativeNetRequestFeedback", "downloads.ui", "system.cpu", "system.display",
    "system.memory", "system.storage", "printerProvider",
]

# --- fixed values: permissions that reach host data --------------------------
HOST_SENSITIVE = {
    "tabCapture", "pageCapture", "cookies", "scripting", "declarativeNetRequest",
    "webRequest", "webRequestBlocking", "userScripts",
    "declarativeNetRequestWithHostAccess", "desktopCapture",
}

PERMISSION_ROWS = [
    (name, category, CATEGORY_WEIGHT[category], name in HOST_SENSITIVE)
    for category, names in (
        ("critical", CRITICAL), ("high", HIGH), ("medium", MEDIUM), ("low", LOW)
    )
    for name in names
]

# --- fixed values: host patterns ---------------------------------------------
HOST_PATTERN = r"^https?://|\*://|<all_urls>"
SCHEME_PATTERN = r"^https?://|\*://"
EVERY_SITE = ["<all_urls>", "*://*/*"]
BROAD_HOSTS = ["<all_urls>", "*://*/*", "http://*/*", "https://*/*"]

# Permissions worth a sentence for the reader: (permission, category, sentence).
DESCRIPTION_ROWS = [
    ("tabCapture", "critical", "Record the audio and video of a tab."),
    ("pageCapture", "critical", "Save complete web pages."),
    ("debugger", "critical", "Attach to the browser debugger and change any page."),
    ("nativeMessaging", "critical", "Talk to programs installed on the computer."),
    ("proxy", "critical", "Send all browser traffic through another server."),
    ("vpnProvider", "critical", "Create and control VPN connections."),
    ("cookies", "high", "Read and change cookies, session tokens included."),
    ("scripting", "high", "Run scripts in visited pages."),
    ("declarativeNetRequest", "high", "Block, redirect or change network requests."),
    ("webRequest", "high", "Observe network requests as they happen."),
    ("webRequestBlocking", "high", "Hold back or block network requests."),
    ("userScripts", "high", "Run arbitrary user scripts in pages."),
    ("desktopCapture", "high", "Record the screen, a window or a tab."),
    ("history", "high", "Read and change the browsing history."),
    ("downloads", "high", "Start, stop and watch downloads."),
    ("downloads.open", "high", "Open downloaded files."),
    ("privacy", "high", "Change the browser's privacy settings."),
    ("browsingData", "high", "Delete history, cookies and cached data."),
    ("contentSettings", "high", "Decide what sites may run or show."),
    ("webNavigation", "high", "Follow every page navigation."),
    ("management", "high", "See, enable or disable other extensions."),
    ("tabs", "medium", "See the address and title of open tabs."),
    ("activeTab", "medium", "Access the current tab on user action."),
    ("bookmarks", "medium", "Read and change bookmarks."),
    ("clipboardRead", "medium", "Read the clipboard."),
    ("clipboardWrite", "medium", "Write to the clipboard."),
    ("geolocation", "medium", "Know the location of the device."),
    ("notifications", "medium", "Show desktop notifications."),
    ("sessions", "medium", "See recently closed tabs and windows."),
    ("topSites", "medium", "See the most visited sites."),
    ("storage", "low", "Keep data in the extension's own storage."),
    ("identity", "low", "Get sign-in tokens for an account."),
    ("alarms", "low", "Schedule periodic work."),
    ("contextMenus", "low", "Add entries to the context menu."),
    ("offscreen", "low", "Use hidden documents in the background."),
    ("sidePanel", "low", "Show content in the side panel."),
]
