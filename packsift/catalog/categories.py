r"""Behaviour categories: detail signals, rules, evidence and state conditions.

``SIGNALS`` are tests on the detail of confirmed findings. ``RULES`` name a category,
a rule id, an optional finding kind and an optional signal. The conditions of
``STATES`` and ``EVIDENCE`` are SQL over the per-package flags: ``s_`` detail signal,
``k_`` finding kind, ``p_`` permission, ``a_`` API use, plus the plain flags listed in
``operators.categories``.
"""

# --- fixed values: category -> (title, order priority) ----------------------------------
CATEGORIES = [
    ("browser_access", "General browser access", 65),
    ("page_modification", "Page modification", 80),
    ("page_reading", "Reading of page content", 90),
    ("credential_capture", "Passwords, tokens and sessions", 100),
    ("keylogging", "Keyboard capture", 95),
    ("tracking", "Tracking and privacy", 75),
    ("traffic_manipulation", "Traffic manipulation", 85),
    ("history_access", "Browsing history", 55),
    ("downloads", "Downloads and files", 45),
    ("transparency", "Obfuscation and transparency", 35),
    ("extension_management", "Abuse of extension management", 72),
    ("resource_mining", "Resource mining", 60),
    ("fingerprinting", "Severe fingerprinting", 70),
]
STATE_WEIGHT = {"critical": 4, "suspicious": 3, "capability": 2, "none": 1}

# --- fixed values: detail signals -----------------------------------------------------------
SIGNALS = {
    # browser_access
    "broad_or_exec_perm": r"(?i)<all_urls>|\*://\*/\*|http://\*/\*|https://\*/\*|scripting|tabs|activeTab",
    "execute_script": r"(?i)chrome\.scripting\.executeScript|chrome\.tabs\.executeScript",
    "tabs_or_nav_api": r"(?i)chrome\.tabs\.query|chrome\.tabs\.get|chrome\.webNavigation|chrome\.windows",
    "tab_open": r"(?i)chrome\.tabs\.create|chrome\.tabs\.update|window\.open|location\.assign|location\.replace",
    # page_modification
    "overlay": r"(?i)position\s*[:=]\s*['\"]?(fixed|absolute)|z-?index\s*[:=]\s*['\"]?(9{3,}|2147483647|99999|999999)|inset\s*[:=]\s*['\"]?0|width\s*[:=]\s*['\"]?100(vw|%)|height\s*[:=]\s*['\"]?100(vh|%)",
    "overlay_words": r"(?i)createElement\(\s*['\"](?:div|iframe)['\"](?s:.{0,200})(?:position|z-?index)|modal|overlay|popup|backdrop",
    "invisible": r"(?i)display\s*[:=]\s*['\"]?none|visibility\s*[:=]\s*['\"]?hidden|opacity\s*[:=]\s*['\"]?0|pointer-events\s*[:=]\s*['\"]?none",
    "form_or_link": r"(?i)createElement\(\s*['\"](?:form|input|button|a|label)['\"]|getElementsByTagName\(\s*['\"](?:form|input|button|a)['\"]|querySelectorAll?\(\s*['\"][^'\"]*(?:form|input|button|a\b|\.btn|\.button)",
    "ad_or_search": r"(?i)\.ad[s]?[-_ ]|advertisement|adsbygoogle|search[-_ ]?result|sponsor|tracker|recommendation",
    "dom_script_words": r"(?i)dom|script|injection|remote",
    "script_or_css": r"(?i)chrome\.scripting\.executeScript|chrome\.tabs\.executeScript|insertCSS|removeCSS",
    "html_or_frame": r"(?i)innerHTML|outerHTML|insertAdjacentHTML|appendChild|prepend|createElement\((script|iframe)|\.src remote",
    "observers_rule": r"(?i)MutationObserver|IntersectionObserver|ResizeObserver|attachShadow|shadowRoot",
    "observers": r"(?i)MutationObserver|IntersectionObserver|attachShadow|shadowRoot",
    "push_state": r"(?i)history\.pushState|history\.replaceState",
    "rewrite": r"(?i)redirect|modifyHeaders|declarativeNetRequest|webRequestBlocking|replace|overlay",
    # page_reading
    "dom_selectors": r"(?i)querySelector|getElementById|getElementsByName|document\.body|document\.documentElement|textContent|innerText|\.value",
    "form_data_rule": r"(?i)document\.forms|HTMLFormElement|FormData|input\[|\.elements\b",
    "form_access": r"(?i)document\.forms|FormData|HTMLFormElement|\.elements\b",
    "message_bridge": r"(?i)window\.postMessage|chrome\.runtime\.onMessage|chrome\.runtime\.sendMessage|message sink",
    "clipboard": r"(?i)navigator\.clipboard|document\.execCommand\(\s*['\"]copy|document\.execCommand\(\s*['\"]paste|ClipboardItem|clipboardData",
    "selection": r"(?i)window\.getSelection|document\.getSelection|getRangeAt",
    "frame_content": r"(?i)contentDocument|contentWindow|frames\[",
    "screenshot": r"(?i)chrome\.tabs\.captureVisibleTab|chrome\.desktopCapture|chrome\.tabCapture|chrome\.pageCapture|getDisplayMedia",
    "uses_dom": r"(?i)document\.(body|documentElement|forms|cookie)|querySelector|getElementById|innerText|textContent",
    # credential_capture
    "credential": r"(?i)credential theft|password|input\[type=[\"']?password|access_token|refresh_token|privatekey|seed phrase|mnemonic",
    "password_field": r"(?i)input\[type=[\"']?password|credential selector:password|password field|autocomplete=[\"']?(?:current|new)-password|name=[\"']?password|name=[\"']?passwd|name=[\"']?pwd",
    "token": r"(?i)access_token|refresh_token|id_token|bearer|authorization|x-auth|api[_-]?key|jwt\b|oauth|session[_-]?id|csrftoken",
    "form_intercept": r"(?i)addEventListener\(\s*['\"]submit['\"]|HTMLFormElement\.prototype\.submit|preventDefault|FormData|\.elements\[|new FormData",
    "identity_api": r"(?i)chrome\.identity\.getAuthToken|chrome\.identity\.launchWebAuthFlow|chrome\.identity\.getProfileUserInfo|chrome\.identity\.getAccounts",
    "credential_data": r"(?i)cookie|password|credential|token|bearer|privatekey|seed phrase|mnemonic|sessionStorage|localStorage|chrome\.storage",
    "session_words": r"(?i)credential|password|cookie|session|token|exfiltration",
    "auth_storage": r"(?i)localStorage|sessionStorage|chrome\.storage|access_token|refresh_token|authorization|bearer",
    "storage_words": r"(?i)sessionStorage|localStorage|chrome\.storage",
    "cookies_word": r"(?i)\bcookies\b",
    # keylogging
    "key_event": r"(?i)addEventListener\(\s*['\"](keydown|keyup|keypress|input|beforeinput|paste|copy|cut|compositionstart|compositionupdate|compositionend)['\"]|onkeydown|onkeyup|oninput|onpaste|oncopy|oncut|KeyboardEvent|InputEvent|CompositionEvent|ClipboardEvent",
    "hotkey": r"(?i)ctrlKey|altKey|metaKey|shiftKey|event\.key|event\.code|keyCode|which|chrome\.commands",
    "paste_copy": r"(?i)addEventListener\(\s*['\"](paste|copy|cut)['\"]|clipboardData|onpaste|oncopy|oncut",
    "ime": r"(?i)compositionstart|compositionupdate|compositionend|CompositionEvent",
    "submit_capture": r"(?i)addEventListener\(\s*['\"]submit['\"]|HTMLFormElement\.prototype\.submit|beforeunload",
    "keyboard_words": r"(?i)keyboard|keylogger",
    # tracking
    "analytics": r"(?i)analytics|telemetry|tracking|segment|mixpanel|amplitude|ga\(|gtag|pixel|fingerprint|clientId|userId|deviceId|google-analytics|googletagmanager|hotjar|posthog|fullstory|matomo|piwik|heap\.io|kissmetrics|fbq\(|fbevents|doubleclick",
    "fingerprint": r"(?i)canvas\.toDataURL|getImageData\b|getContext\(['\"]webgl|WebGLRenderingContext|AudioContext|OfflineAudioContext|navigator\.hardwareConcurrency|navigator\.deviceMemory|navigator\.platform|navigator\.userAgent|navigator\.languages|navigator\.plugins|screen\.colorDepth|screen\.pixelDepth|screen\.width|screen\.height|Intl\.DateTimeFormat\(\)\.resolvedOptions|MediaDevices\.enumerateDevices",
    "persistent_id": r"(?i)crypto\.randomUUID|generateUUID|uuid\(|v4\(\)|deviceId|clientId|installId|machineId|fingerprintjs|FingerprintJS|client_id\b|device_id\b|install_id\b",
    "beacon": r"(?i)document\.referrer|navigator\.sendBeacon|Beacon API",
    "ecommerce": r"(?i)ecommerceEnabled|clickstreamEnabled|advertisementEnabled|ECOMMERCE_TRACK|ECOMMERCE_HEART_BEAT|panalyticsId|DataSharingTypes",
    "adware": r"(?i)bis_data|PANELOS_MESSAGE|posdMessageId|BIS_SEPARATOR",
    "shopify": r"(?i)SHOPIFY_DETECTED|ECOMMERCE_INIT_SHOPIFY|globalThis\.Shopify",
    "send_message": r"(?i)sendMessage|postMessage",
    "network_words": r"(?i)network|domain|fetch|sendbeacon|websocket",
    "activity_api": r"(?i)chrome\.tabs|chrome\.history|chrome\.webNavigation|chrome\.webRequest|chrome\.cookies",
    # traffic_manipulation
    "request_intercept": r"(?i)chrome\.webRequest|onBeforeRequest|onBeforeSendHeaders|onHeadersReceived|onResponseStarted|onBeforeRedirect|onAuthRequired|blocking|requestHeaders|responseHeaders",
    "rules_api": r"(?i)chrome\.declarativeNetRequest|updateDynamicRules|updateSessionRules|updateEnabledRulesets|getDynamicRules",
    "rules_action": r"(?i)modifyHeaders|redirect|block|upgradeScheme",
    "dynamic_rules": r"(?i)updateDynamicRules|updateSessionRules|updateEnabledRulesets",
    "header_rewrite": r"(?i)modifyHeaders|setRequestHeader|removeHeader|setResponseHeader|Authorization|Cookie|Referer|Origin",
    "redirect": r"(?i)redirect|upgradeScheme|window\.location|location\.replace|location\.assign",
    "proxy_words": r"(?i)chrome\.proxy|vpnProvider|ProxyConfig|PacScript|FixedServers",
    "download_intercept": r"(?i)chrome\.downloads\.onDeterminingFilename|chrome\.downloads\.onCreated|chrome\.downloads\.onChanged",
    "traffic_words": r"(?i)webrequest|traffic|redirect|proxy|declarativenetrequest|surveillance|intercept",
    "network_perm": r"(?i)webRequest|webRequestBlocking|declarativeNetRequest|proxy",
    "network_hook": r"(?i)xhr_prototype_hook|fetch_hook",
    "history_word": r"(?i)history",
    # history_access
    "history_perm": r"(?i)history|tabs|webNavigation|bookmarks|topSites|sessions",
    "history_api": r"(?i)chrome\.history\.search|chrome\.history\.getVisits|chrome\.history\.addUrl|chrome\.history\.deleteUrl|chrome\.history\.deleteRange|chrome\.history\b",
    "tabs_events": r"(?i)chrome\.tabs\.query|chrome\.tabs\.get\b|chrome\.tabs\.onUpdated|chrome\.tabs\.onActivated|chrome\.tabs\.onCreated|chrome\.tabs\.onRemoved",
    "web_navigation": r"(?i)chrome\.webNavigation|onBeforeNavigate|onCommitted|onCompleted|onHistoryStateUpdated|onReferenceFragmentUpdated",
    "bookmarks": r"(?i)chrome\.bookmarks|chrome\.topSites|chrome\.sessions",
    "url_words": r"(?i)tab\.url|tab\.title|url|history|webNavigation|title|location\.href",
    # downloads
    "downloads_word": r"(?i)downloads",
    "download_api": r"(?i)chrome\.downloads\.download|chrome\.downloads\.open|chrome\.downloads\.erase|chrome\.downloads\.removeFile|chrome\.downloads\.show",
    "download_call": r"(?i)download\s*\(",
    "download_event": r"(?i)chrome\.downloads\.onCreated|chrome\.downloads\.onChanged|chrome\.downloads\.onDeterminingFilename",
    "file_access": r"(?i)showSaveFilePicker|showOpenFilePicker|showDirectoryPicker|FileSystemFileHandle|FileSystemDirectoryHandle|webkitDirectory|chrome\.fileSystem",
    "blob": r"(?i)new Blob\(|URL\.createObjectURL|application/octet-stream|application/x-msdownload|application/x-msi",
    "executable": r"(?i)\.exe(?:['\"\s/?#&)]|$)|\.msi\b|\.dmg\b|\.scr\b|\.bat\b|\.ps1\b|\.sh\b|\.cmd\b|\.com\b|\.jar\b|\.apk\b|\.dll\b|\.vbs\b|\.pkg\b|\.deb\b|\.rpm\b",
    "archive": r"(?i)\.zip\b|\.rar\b|\.7z\b|\.tar\b|\.gz\b|\.tgz\b",
    # transparency
    "encoder": r"(?i)atob\s*\(|String\.fromCharCode\(|String\.fromCodePoint\(|btoa\s*\(|unescape\s*\(|decodeURI(?:Component)?\s*\(",
    "dynamic_exec": r"(?i)\beval\s*\(|new Function\s*\(|setTimeout\(\s*['\"]|setInterval\(\s*['\"]|Function\(['\"]",
    "hex_names": r"_0x[a-fA-F0-9]{2,}|var\s+_0x|let\s+_0x|const\s+_0x|0x[a-fA-F0-9]{4,}\s*[,)\]]",
    "anti_debug": r"(?i)debugger\b|devtools|anti[-_ ]?debug|Function\.constructor|performance\.now|console\.clear|toString\(\)\.length|window\.outerWidth\s*-\s*window\.innerWidth|console\.profile|console\.profileEnd",
    "packer": r"(?i)eval\(function\(p,a,c,k,e,[dr]\)|jsfuck|JSFuck|aaencode|obfuscator\.io|webpack[Cc]hunk_|p_a_c_k_e_r",
    "hidden_words": r"(?i)obfuscation|remote script|eval",
    # extension_management
    "management_word": r"(?i)\bmanagement\b",
    "management_read": r"(?i)chrome\.management\.(getAll|get|getPermissionWarningsById|getPermissionWarningsByManifest)\b",
    "management_write": r"(?i)chrome\.management\.(setEnabled|uninstall|uninstallSelf|launchApp)\b",
    # resource_mining
    "wasm": r"(?i)WebAssembly\.(instantiate|compile|compileStreaming|instantiateStreaming)\b|new\s+WebAssembly\.Instance\b",
    "worker": r"(?i)new\s+Worker\s*\(|new\s+SharedWorker\s*\(",
    "mining_pool": r"(?i)coinhive|coin-hive|crypto-loot|minero\.pw|webmine\.pro|wshost\.live|hashvault|supportxmr|xmrpool|nanopool|mineXMR|moneroocean|2miners|cryptonight|cnhashing|wasm-miner|monerominer|xmrig\b",
    "wasm_file": r"(?i)\.wasm(?:['\"\s?#&)]|$)|application/wasm",
    "stealth_mining": r"(?i)cpuLimit|setThrottle|idle.*mine|mine.*idle|backgroundMine|miner\.start|miner\.stop|hashRate|getHashesPerSecond",
    "stratum": r"(?i)\"method\"\s*:\s*\"(mining\.submit|mining\.subscribe|mining\.authorize|login|submit|keepalived)\"|stratum\+tcp|stratum\+ssl|\"result\"\s*:\s*null.*\"id\"\s*:|pool\.(nonce|difficulty|job_id)|\"blob\"\s*:|\"target\"\s*:|\"job_id\"\s*:",
    "keepalive": r"(?i)chrome\.alarms\.create.*period|periodInMinutes\s*:\s*0\.|keepAlive|keep_alive|ping.*worker|worker.*ping|self\.registration\.active|clients\.claim\(\)",
    # fingerprinting
    "fp_canvas": r"(?i)(?:HTMLCanvasElement\.prototype\.|canvas\.)toDataURL\b|getImageData\b|HTMLCanvasElement\.prototype\.getContext\b",
    "fp_webgl": r"(?i)gl\.getParameter\b|gl\.getExtension\b|WEBGL_debug_renderer_info|WebGLRenderingContext|WebGL2RenderingContext|getContext\(['\"](webgl|experimental-webgl|webgl2)",
    "fp_audio": r"(?i)new\s+(?:AudioContext|OfflineAudioContext)\b|createOscillator\b|createAnalyser\b|createDynamicsCompressor\b|getChannelData\b|copyFromChannel\b",
    "fp_hardware": r"(?i)navigator\.hardwareConcurrency\b|navigator\.deviceMemory\b|navigator\.platform\b|navigator\.userAgent\b|navigator\.plugins\b|navigator\.mimeTypes\b|navigator\.languages\b|screen\.colorDepth\b|screen\.pixelDepth\b|screen\.width\b|screen\.height\b|window\.devicePixelRatio\b|Intl\.DateTimeFormat\(\)\.resolvedOptions|MediaDevices\.enumerateDevices",
    "fp_fonts": r"(?i)measureText\b|offsetWidth.*font|fontFamily.*loop|document\.fonts\.check|FontFaceObserver|fontList|installedFonts",
    "fp_library": r"(?i)fingerprint|fp_hash|browser_id|client_hash|device_hash|visitorId|visitor_id|fp2\b|fingerprintjs|FingerprintJS|@fingerprintjs/fingerprintjs",
}

# --- fixed values: rules (category, rule id, kind or None, signals any of, or None) --------------
RULES = [
    ("browser_access", "general.broad_host_or_execution_permission", "permission_risky", ["broad_or_exec_perm"]),
    ("browser_access", "general.programmatic_script_execution", None, ["execute_script"]),
    ("browser_access", "general.tabs_or_navigation_api", None, ["tabs_or_nav_api"]),
    ("browser_access", "general.tab_creation_or_open", None, ["tab_open"]),
    ("page_modification", "page_mod.dom_injection", "dom_injection", None),
    ("page_modification", "page_mod.remote_script_mv3", "remote_script", None),
    ("page_modification", "page_mod.correlation_dom_script", "correlation", ["dom_script_words"]),
    ("page_modification", "page_mod.programmatic_script_execution", None, ["script_or_css"]),
    ("page_modification", "page_mod.html_or_frame_injection", None, ["html_or_frame"]),
    ("page_modification", "page_mod.form_or_link_replacement", None, ["form_or_link"]),
    ("page_modification", "page_mod.ad_or_search_replacement", None, ["ad_or_search"]),
    ("page_modification", "page_mod.invisible_element", None, ["invisible"]),
    ("page_modification", "page_mod.fake_overlay", None, ["overlay", "overlay_words"]),
    ("page_modification", "page_mod.mutation_observer", None, ["observers_rule"]),
    ("page_modification", "page_mod.history_pushstate", None, ["push_state"]),
    ("page_modification", "page_mod.redirect_or_rewrite", None, ["rewrite"]),
    ("page_reading", "read_info.sensitive_flow", "data_flow", None),
    ("page_reading", "read_info.cookie_access", "cookie_read", None),
    ("page_reading", "read_info.browser_storage_access", "storage_read", None),
    ("page_reading", "read_info.input_or_keyboard_listener", "input_listener", None),
    ("page_reading", "read_info.dom_selectors", None, ["dom_selectors"]),
    ("page_reading", "read_info.form_data", None, ["form_data_rule"]),
    ("page_reading", "read_info.page_message_bridge", None, ["message_bridge"]),
    ("page_reading", "read_info.clipboard_read", None, ["clipboard"]),
    ("page_reading", "read_info.selection_api", None, ["selection"]),
    ("page_reading", "read_info.iframe_content", None, ["frame_content"]),
    ("page_reading", "read_info.screenshot_or_capture", None, ["screenshot"]),
    ("credential_capture", "creds.cookie_access", "cookie_read", None),
    ("credential_capture", "creds.sensitive_flow", "data_flow", ["credential_data"]),
    ("credential_capture", "creds.correlation_session_exfil", "correlation", ["session_words"]),
    ("credential_capture", "creds.secret_reference", None, ["credential"]),
    ("credential_capture", "creds.password_selector", None, ["password_field"]),
    ("credential_capture", "creds.token_reference", None, ["token"]),
    ("credential_capture", "creds.form_interception", None, ["form_intercept"]),
    ("credential_capture", "creds.auth_storage", None, ["auth_storage"]),
    ("credential_capture", "creds.chrome_identity", None, ["identity_api"]),
    ("credential_capture", "creds.cookies_permission", "permission_risky", ["cookies_word"]),
    ("keylogging", "keylog.keyboard_listener", "input_listener", None),
    ("keylogging", "keylog.correlation_keylogger", "correlation", ["keyboard_words"]),
    ("keylogging", "keylog.input_event_capture", None, ["key_event"]),
    ("keylogging", "keylog.hotkey_monitoring", None, ["hotkey"]),
    ("keylogging", "keylog.clipboard_intercept", None, ["paste_copy"]),
    ("keylogging", "keylog.ime_composition", None, ["ime"]),
    ("keylogging", "keylog.form_submit_capture", None, ["submit_capture"]),
    ("keylogging", "keylog.network_exfil", "data_flow", None),
    ("tracking", "privacy.data_flow", "data_flow", None),
    ("tracking", "privacy.storage_access", "storage_read", None),
    ("tracking", "privacy.message_bridge", "risky_call", ["send_message"]),
    ("tracking", "privacy.network_correlation", "correlation", ["network_words"]),
    ("tracking", "privacy.external_context_navigation", "sensitive_navigation", None),
    ("tracking", "privacy.analytics_or_tracking", None, ["analytics"]),
    ("tracking", "privacy.fingerprinting", None, ["fingerprint"]),
    ("tracking", "privacy.persistent_identifier", None, ["persistent_id"]),
    ("tracking", "privacy.beacon_or_referrer", None, ["beacon"]),
    ("tracking", "privacy.browsing_activity_api", None, ["activity_api"]),
    ("tracking", "privacy.ecommerce_tracking", None, ["ecommerce"]),
    ("tracking", "privacy.adware_framework", None, ["adware"]),
    ("tracking", "privacy.shopify_tracking", None, ["shopify"]),
    ("traffic_manipulation", "traffic.correlation_rewrite", "correlation", ["traffic_words"]),
    ("traffic_manipulation", "traffic.permission_network_control", "permission_risky", ["network_perm"]),
    ("traffic_manipulation", "traffic.request_interception_api", None, ["request_intercept"]),
    ("traffic_manipulation", "traffic.dnr_redirect_or_modify", None, ["rules_api", "rules_action"]),
    ("traffic_manipulation", "traffic.dynamic_dnr_rules", None, ["dynamic_rules"]),
    ("traffic_manipulation", "traffic.header_rewrite", None, ["header_rewrite"]),
    ("traffic_manipulation", "traffic.redirect_pattern", None, ["redirect"]),
    ("traffic_manipulation", "traffic.download_interception", None, ["download_intercept"]),
    ("traffic_manipulation", "traffic.proxy_or_vpn", None, ["proxy_words"]),
    ("traffic_manipulation", "traffic.xhr_fetch_hook", "api_hook", ["network_hook"]),
    ("traffic_manipulation", "traffic.history_api_hook", "api_hook", ["history_word"]),
    ("traffic_manipulation", "traffic.geolocation_spoof", "api_spoof", None),
    ("history_access", "history.permission_history_or_tabs", "permission_risky", ["history_perm"]),
    ("history_access", "history.history_api_usage", None, ["history_api"]),
    ("history_access", "history.tabs_navigation_events", None, ["tabs_events"]),
    ("history_access", "history.webnavigation_listener", None, ["web_navigation"]),
    ("history_access", "history.bookmarks_top_sessions", None, ["bookmarks"]),
    ("history_access", "history.url_transmission", "data_flow", ["url_words"]),
    ("downloads", "downloads.permission_downloads", "permission_risky", ["downloads_word"]),
    ("downloads", "downloads.download_api_usage", None, ["download_api", "download_call"]),
    ("downloads", "downloads.download_events", None, ["download_event"]),
    ("downloads", "downloads.fs_access_api", None, ["file_access"]),
    ("downloads", "downloads.blob_generation", None, ["blob"]),
    ("downloads", "downloads.executable_extension", None, ["executable"]),
    ("downloads", "downloads.archive_extension", None, ["archive"]),
    ("transparency", "transparency.obfuscated_code", "obfuscated", None),
    ("transparency", "transparency.minified_code", "minified", None),
    ("transparency", "transparency.remote_code", "remote_script", None),
    ("transparency", "transparency.dynamic_execution", "risky_call", ["dynamic_exec"]),
    ("transparency", "transparency.encoders", None, ["encoder"]),
    ("transparency", "transparency.hex_identifiers", None, ["hex_names"]),
    ("transparency", "transparency.packer_signature", None, ["packer"]),
    ("transparency", "transparency.correlation_hidden_execution", "correlation", ["hidden_words"]),
    ("transparency", "transparency.anti_debugging", None, ["anti_debug"]),
    ("transparency", "transparency.orphan_file", "orphan_file", None),
    ("transparency", "transparency.grep_large_file", "large_file_signal", None),
    ("extension_management", "management.permission", "permission_risky", ["management_word"]),
    ("extension_management", "management.read_extensions", None, ["management_read"]),
    ("extension_management", "management.disable_extension", None, ["management_write"]),
    ("resource_mining", "mining.wasm_init", None, ["wasm"]),
    ("resource_mining", "mining.web_worker", None, ["worker"]),
    ("resource_mining", "mining.known_domain", None, ["mining_pool"]),
    ("resource_mining", "mining.wasm_file", None, ["wasm_file"]),
    ("resource_mining", "mining.stealth_pattern", None, ["stealth_mining"]),
    ("resource_mining", "mining.stratum_protocol", None, ["stratum"]),
    ("resource_mining", "mining.sw_keepalive", None, ["keepalive"]),
    ("fingerprinting", "fp.canvas", None, ["fp_canvas"]),
    ("fingerprinting", "fp.webgl", None, ["fp_webgl"]),
    ("fingerprinting", "fp.audio", None, ["fp_audio"]),
    ("fingerprinting", "fp.hardware_enum", None, ["fp_hardware"]),
    ("fingerprinting", "fp.font_enum", None, ["fp_fonts"]),
    ("fingerprinting", "fp.exfiltration_library", None, ["fp_library"]),
]

# --- fixed values: host tests and API-use tests -----------------------------------------------------
SENSITIVE_ACCESS_HOST = r"(?i)bank|paypal|stripe|gmail|outlook|mail|drive|dropbox|onedrive|facebook|instagram|whatsapp|metamask|binance|coinbase|chase|wellsfargo|santander|bbva"
SENSITIVE_READ_HOST = r"(?i)mail\.google|gmail|outlook|protonmail|drive\.google|docs\.google|onedrive|dropbox|sharepoint|notion|slack|teams|whatsapp|telegram|messenger|bank|paypal|stripe|metamask|binance|coinbase"
BROAD_DETAIL = r"<all_urls>|\*://\*/\*|http://\*/\*|https://\*/\*"
SENSITIVE_DOMAIN_CATEGORIES = ["financial", "identity", "llm", "mail", "social", "government"]
API_USE = {
    "a_script_execute": r"^chrome\.(scripting\.executeScript|tabs\.executeScript|scripting\.insertCSS|tabs\.insertCSS)",
    "a_tab_observe": r"^chrome\.tabs\.(query|get|onActivated|onUpdated|onCreated|onRemoved)",
    "a_nav_observe": r"^chrome\.webNavigation\.",
    "a_tab_open": r"^chrome\.tabs\.(create|update|highlight|move)|^window\.open|^location\.(assign|replace)",
    "a_execute_only": r"chrome\.(scripting|tabs)\.executeScript",
    "a_browse_observe": r"^chrome\.(tabs\.(query|get|onActivated|onUpdated|onCreated|onRemoved)|webNavigation\.|history\.)",
    "a_management": r"(?i)chrome\.management\.",
}
FLAG_PERMISSIONS = [
    "tabs", "scripting", "cookies", "history", "webNavigation", "downloads", "webRequest",
    "webRequestBlocking", "declarativeNetRequest", "declarativeNetRequestWithHostAccess",
    "proxy", "management", "bookmarks", "topSites", "sessions",
]
# Signals restricted to flows.
FLOW_SIGNALS = {"f_credential": "credential_data", "f_url": "url_words"}

# --- fixed values: states, first true of critical / suspicious / capability ---------------------------
STATES = {
    "browser_access": (
        "broad_host AND a_script_execute AND (first_execute_background OR invisible_execution)",
        "a_script_execute OR a_tab_observe OR a_nav_observe OR (broad_host AND (p_scripting OR auto_run))",
        "broad_host OR p_tabs OR has_content_script"),
    "page_modification": (
        "k_remote_script OR (s_overlay AND k_dom_injection) OR (a_script_execute AND broad_host)",
        "k_dom_injection OR a_script_execute OR s_overlay OR s_invisible OR s_observers OR s_form_or_link",
        "p_scripting AND NOT a_script_execute"),
    "page_reading": (
        "k_data_flow OR s_screenshot OR (a_execute_only AND broad_host)",
        "k_cookie_read OR k_storage_read OR s_form_access OR s_clipboard OR s_selection OR matches_read_host OR s_uses_dom",
        "broad_host"),
    "credential_capture": (
        "((s_credential OR s_password_field OR s_token OR k_cookie_read) AND f_credential) OR (s_password_field AND s_form_intercept)",
        "s_credential OR s_password_field OR s_token OR k_cookie_read OR s_form_intercept OR s_identity_api OR p_cookies",
        "s_storage_words"),
    "keylogging": (
        "(k_input_listener OR s_paste_copy OR s_ime OR s_hotkey OR s_submit_capture) AND k_data_flow",
        "k_input_listener OR s_paste_copy OR s_ime OR s_hotkey OR s_submit_capture",
        "FALSE"),
    "tracking": (
        "(s_fingerprint AND k_data_flow) OR (broad_host AND s_analytics AND k_data_flow)",
        "s_analytics OR s_fingerprint OR s_persistent_id OR s_beacon OR s_ecommerce OR s_adware OR s_shopify OR n_contacts > 0 OR k_sensitive_navigation OR a_browse_observe",
        "(p_tabs OR p_webNavigation) AND NOT a_browse_observe"),
    "traffic_manipulation": (
        "p_proxy OR p_webRequestBlocking OR (s_dynamic_rules AND s_header_rewrite) OR k_api_hook",
        "FALSE",
        "p_webRequest OR p_declarativeNetRequest OR s_header_rewrite OR s_download_intercept OR k_api_spoof"),
    "history_access": (
        "(s_history_api AND f_url) OR (s_web_navigation AND f_url)",
        "p_history OR s_history_api OR s_web_navigation OR s_bookmarks OR s_tabs_events",
        "p_tabs"),
    "downloads": (
        "(s_download_api AND s_executable) OR (s_download_event AND (s_executable OR s_archive))",
        "p_downloads OR s_download_api OR s_download_event OR s_file_access OR (s_blob AND s_executable)",
        "FALSE"),
    "transparency": (
        "(s_anti_debug AND (k_obfuscated OR s_hex_names OR s_packer)) OR (s_packer AND s_dynamic_exec)",
        "k_obfuscated OR k_remote_script OR s_hex_names OR s_packer OR (s_encoder AND s_dynamic_exec) OR s_anti_debug OR k_orphan_file",
        "k_minified OR k_large_file_signal"),
    "extension_management": (
        "s_management_write",
        "s_management_read OR (p_management AND a_management)",
        "p_management AND NOT a_management"),
    "resource_mining": (
        "s_mining_pool OR s_stratum OR s_stealth_mining OR (s_keepalive AND (s_wasm OR s_wasm_file)) OR ((s_wasm OR s_wasm_file) AND s_worker AND k_data_flow)",
        "s_wasm OR s_wasm_file OR s_worker OR (s_keepalive AND k_data_flow)",
        "FALSE"),
    "fingerprinting": (
        "s_fp_library OR (n_techniques >= 2 AND k_data_flow) OR n_techniques >= 3",
        "n_techniques >= 1",
        "FALSE"),
}
FP_TECHNIQUES = ["s_fp_canvas", "s_fp_webgl", "s_fp_audio", "s_fp_hardware", "s_fp_fonts"]

# Evidence sentences an evaluator may add, in order (category, condition, text).
EVIDENCE = [
    ("browser_access", "broad_host", "May run on every site."),
    ("browser_access", "a_script_execute", "Inserts code into pages."),
    ("browser_access", "p_scripting AND NOT a_script_execute", "May insert code into pages; no use seen."),
    ("browser_access", "a_tab_observe OR a_nav_observe", "Watches tabs and visited sites."),
    ("browser_access", "p_tabs AND NOT (a_tab_observe OR a_nav_observe)", "May see tabs; no use seen."),
    ("browser_access", "has_content_script", "Runs on visited pages by itself."),
    ("browser_access", "auto_run", "Starts while a page loads."),
    ("browser_access", "has_background AND a_script_execute", "Background process inserts code."),
    ("browser_access", "sensitive_reach", "Set up for sensitive sites."),
    ("browser_access", "invisible_execution", "Has no visible window."),
    ("browser_access", "a_tab_open", "Opens tabs or redirects from code."),
    ("page_modification", "k_dom_injection", "Changes page content."),
    ("page_modification", "a_script_execute", "Inserts code through the scripting API."),
    ("page_modification", "p_scripting AND NOT a_script_execute", "May insert code; no use seen."),
    ("page_modification", "k_remote_script", "Loads code from the Internet."),
    ("page_modification", "s_overlay", "May cover the page with layers."),
    ("page_modification", "s_invisible", "May hide page elements."),
    ("page_modification", "s_observers", "Watches page changes."),
    ("page_modification", "s_form_or_link", "May replace buttons, forms or links."),
    ("page_modification", "s_push_state", "May change the visible address."),
    ("page_reading", "k_data_flow", "Page data leaves for a server."),
    ("page_reading", "a_execute_only", "Inserted code can read the page."),
    ("page_reading", "s_uses_dom", "Reads visible page content."),
    ("page_reading", "k_cookie_read", "Reads cookies."),
    ("page_reading", "k_storage_read", "Reads site storage."),
    ("page_reading", "s_form_access", "May read forms."),
    ("page_reading", "s_clipboard", "May read the clipboard."),
    ("page_reading", "s_selection", "May read selected text."),
    ("page_reading", "s_screenshot", "May take screenshots."),
    ("page_reading", "matches_read_host", "Runs on mail, banking or social sites."),
    ("page_reading", "s_frame_content", "May read embedded frames."),
    ("credential_capture", "s_credential", "Code mentions passwords, tokens or recovery phrases."),
    ("credential_capture", "s_password_field", "Looks for password fields."),
    ("credential_capture", "s_token", "Code mentions session tokens or keys."),
    ("credential_capture", "k_cookie_read", "Reads cookies."),
    ("credential_capture", "p_cookies", "May access cookies."),
    ("credential_capture", "s_form_intercept", "May capture forms before sending."),
    ("credential_capture", "s_identity_api", "Asks the browser for account tokens."),
    ("credential_capture", "f_credential", "Session data leaves for a server."),
    ("keylogging", "k_input_listener", "Listens to the keyboard."),
    ("keylogging", "s_hotkey", "Detects keys or shortcuts."),
    ("keylogging", "s_paste_copy", "Detects copy and paste."),
    ("keylogging", "s_ime", "Captures composed text."),
    ("keylogging", "s_submit_capture", "May read a form on submit."),
    ("keylogging", "k_data_flow", "Also sends data to a server."),
    ("tracking", "n_contacts > 0", "Contacts external sites."),
    ("tracking", "k_sensitive_navigation", "Opens links that carry page context."),
    ("tracking", "s_analytics", "Uses analytics."),
    ("tracking", "s_fingerprint", "Collects device traits."),
    ("tracking", "s_persistent_id", "Uses a lasting identifier."),
    ("tracking", "s_beacon", "Sends activity in the background."),
    ("tracking", "p_tabs AND NOT a_browse_observe", "May see tabs; no use seen."),
    ("tracking", "p_tabs AND a_browse_observe", "Watches open tabs."),
    ("tracking", "p_webNavigation", "May log each page change."),
    ("tracking", "broad_host", "May relate activity across sites."),
    ("tracking", "k_storage_read", "Keeps information in the browser."),
    ("traffic_manipulation", "p_proxy", "Permission proxy."),
    ("traffic_manipulation", "p_webRequest", "Permission webRequest."),
    ("traffic_manipulation", "p_webRequestBlocking", "Permission webRequestBlocking."),
    ("traffic_manipulation", "p_declarativeNetRequest", "Permission declarativeNetRequest."),
    ("traffic_manipulation", "p_declarativeNetRequestWithHostAccess", "Permission declarativeNetRequestWithHostAccess."),
    ("traffic_manipulation", "s_dynamic_rules", "Changes network rules at run time."),
    ("traffic_manipulation", "s_header_rewrite", "Rewrites request headers."),
    ("traffic_manipulation", "s_redirect", "Redirects navigation."),
    ("traffic_manipulation", "s_download_intercept", "Intercepts downloads."),
    ("traffic_manipulation", "k_api_hook", "Replaces native network functions."),
    ("traffic_manipulation", "k_api_spoof", "Replaces geolocation."),
    ("history_access", "p_history", "May read the history."),
    ("history_access", "p_tabs", "May see open tabs."),
    ("history_access", "p_webNavigation", "May follow page changes."),
    ("history_access", "p_bookmarks", "May read bookmarks."),
    ("history_access", "p_topSites", "May see top sites."),
    ("history_access", "p_sessions", "May see recent sessions."),
    ("history_access", "s_history_api", "Queries the history."),
    ("history_access", "s_tabs_events", "Learns of each opened page."),
    ("history_access", "s_web_navigation", "Logs page changes."),
    ("history_access", "s_bookmarks", "Reads bookmarks or sessions."),
    ("history_access", "f_url", "Addresses or titles leave for a server."),
    ("downloads", "p_downloads", "Permission downloads."),
    ("downloads", "s_download_api", "Calls the download API."),
    ("downloads", "s_download_event", "Listens to download events."),
    ("downloads", "s_file_access", "Uses file pickers."),
    ("downloads", "s_blob", "Builds files in the browser."),
    ("downloads", "s_executable", "Refers to executables."),
    ("downloads", "s_archive", "Refers to archives."),
    ("transparency", "k_obfuscated", "Obfuscation detected."),
    ("transparency", "k_minified", "Minified files."),
    ("transparency", "k_remote_script", "Remote script."),
    ("transparency", "s_packer", "Known packer signature."),
    ("transparency", "s_hex_names", "Hex identifiers."),
    ("transparency", "s_encoder", "Uses decoders."),
    ("transparency", "s_dynamic_exec", "Runs code built at run time."),
    ("transparency", "s_anti_debug", "Anti-debugging signs."),
    ("transparency", "k_orphan_file", "Files nothing refers to."),
    ("transparency", "k_large_file_signal", "Risk signals in very large files."),
    ("extension_management", "p_management", "Permission management."),
    ("extension_management", "s_management_read", "Lists installed extensions."),
    ("extension_management", "s_management_write", "Disables or removes extensions."),
    ("extension_management", "NOT p_management AND s_management_write", "Removes itself."),
    ("resource_mining", "s_wasm OR s_wasm_file", "Loads WebAssembly."),
    ("resource_mining", "s_worker", "Creates workers."),
    ("resource_mining", "k_data_flow AND (s_wasm OR s_wasm_file)", "WebAssembly with network sending."),
    ("resource_mining", "s_mining_pool", "Refers to a mining pool."),
    ("resource_mining", "s_stratum", "Mining protocol signs."),
    ("resource_mining", "s_stealth_mining", "CPU throttling or hash-rate logic."),
    ("resource_mining", "s_keepalive", "Keeps its worker awake."),
    ("fingerprinting", "s_fp_canvas", "Canvas fingerprinting."),
    ("fingerprinting", "s_fp_webgl", "WebGL fingerprinting."),
    ("fingerprinting", "s_fp_audio", "Audio fingerprinting."),
    ("fingerprinting", "s_fp_hardware", "Hardware enumeration."),
    ("fingerprinting", "s_fp_fonts", "Font enumeration."),
    ("fingerprinting", "s_fp_library", "Fingerprinting library."),
    ("fingerprinting", "k_data_flow AND n_techniques > 0", "Fingerprint data leaves the device."),
]

# --- fixed values: manifest evidence (category, permissions any of, text) ----------------------------------
MANIFEST_EVIDENCE = [
    ("browser_access", "broad_pattern", "Host permissions reach many or all sites."),
    ("browser_access", "has_content_script", "Content scripts run when pages are visited."),
    ("page_reading", "has_content_script", "Content scripts can read the pages they run on."),
    ("page_modification", "p_scripting", "Permission scripting allows code injection."),
    ("history_access", "p_tabs", "Can see the address and title of open tabs."),
    ("tracking", "p_tabs", "Can observe navigation through tabs."),
    ("history_access", "p_history", "Permission history allows reading the history."),
    ("credential_capture", "p_cookies", "Permission cookies can expose sessions."),
    ("downloads", "p_downloads", "Permission downloads allows managing downloads."),
    ("traffic_manipulation", "p_webRequest OR p_declarativeNetRequest", "Can observe, block or redirect requests."),
    ("traffic_manipulation", "p_webRequestBlocking OR p_proxy", "Holds high-impact traffic permissions."),
]

# --- fixed values: verdict and answers ------------------------------------------------------------------------
DIRECT_ABUSE = [
    "credential_capture", "keylogging", "page_modification", "traffic_manipulation",
    "extension_management", "resource_mining", "fingerprinting",
]
ANSWERS = [
    ("can_capture_passwords", "credential_capture"), ("can_log_keys", "keylogging"),
    ("can_read_forms", "page_reading"), ("can_modify_pages", "page_modification"),
    ("can_intercept_traffic", "traffic_manipulation"), ("can_see_visited_pages", "browser_access"),
    ("can_see_history", "history_access"), ("hidden_code", "transparency"),
    ("can_affect_extensions", "extension_management"),
]
SPYING = ["credential_capture", "keylogging", "page_reading"]
