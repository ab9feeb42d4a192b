"""Domain catalogues. Category names are ours; the members are fixed values."""

# --- fixed values: technical infrastructure ----------------------------------
INFRASTRUCTURE = [
    "fonts.googleapis.com", "fonts.gstatic.com", "unpkg.com", "jsdelivr.net",
    "cdnjs.cloudflare.com", "ajax.googleapis.com", "www.googleapis.com",
    "storage.googleapis.com", "google-analytics.com", "googletagmanager.com",
    "analytics.google.com", "doubleclick.net", "googlesyndication.com", "sentry.io",
    "bugsnag.com", "rollbar.com", "segment.io", "mixpanel.com", "amplitude.com",
    "cloudflare.com", "fastly.net", "akamaihd.net", "cloudfront.net",
    "registry.npmjs.org", "yarnpkg.com", "bootstrapcdn.com", "jquery.com", "run.app",
    "a.run.app", "cloudfunctions.net", "appspot.com", "firebaseapp.com",
    "firebaseio.com", "web.app", "herokuapp.com", "netlify.app", "vercel.app",
    "pages.dev", "github.io", "github.com", "api.github.com",
    "raw.githubusercontent.com", "objects.githubusercontent.com", "vuejs.org",
    "v3-migration.vuejs.org", "cli.vuejs.org", "reactjs.org", "svelte.dev",
    "angular.io", "w3.org", "www.w3.org", "meyerweb.com", "schema.org", "tc39.es",
    "ecma-international.org", "developer.mozilla.org",
]
HOSTED_SUFFIXES = [
    ".run.app", ".cloudfunctions.net", ".appspot.com", ".firebaseapp.com",
    ".firebaseio.com", ".web.app", ".netlify.app", ".vercel.app",
]

# --- fixed values: sensitive platforms ---------------------------------------
LLM = {
    "chat.openai.com": "ChatGPT", "chatgpt.com": "ChatGPT",
    "platform.openai.com": "OpenAI Platform", "api.openai.com": "OpenAI API",
    "claude.ai": "Claude", "anthropic.com": "Anthropic",
    "api.anthropic.com": "Anthropic API", "gemini.google.com": "Gemini",
    "bard.google.com": "Bard", "aistudio.google.com": "Google AI Studio",
    "generativelanguage.googleapis.com": "Google Gen Language",
    "copilot.microsoft.com": "Microsoft Copilot", "bing.com/chat": "Bing Chat",
    "perplexity.ai": "Perplexity", "huggingface.co": "HuggingFace",
    "mistral.ai": "Mistral", "cohere.ai": "Cohere", "cohere.com": "Cohere",
    "replicate.com": "Replicate", "character.ai": "Character.AI", "poe.com": "Poe",
}
FINANCIAL = {
    "paypal.com": "PayPal", "stripe.com": "Stripe", "mercadopago.com": "Mercado Pago",
    "mercadopago.com.co": "Mercado Pago", "bancolombia.com": "Bancolombia",
    "davivienda.com": "Davivienda", "davivienda.com.co": "Davivienda",
    "bbva.com": "BBVA", "nequi.com.co": "Nequi", "chase.com": "Chase",
    "bankofamerica.com": "Bank of America", "wellsfargo.com": "Wells Fargo",
    "citibank.com": "Citibank", "nubank.com.br": "Nubank", "nu.com.co": "Nu",
    "binance.com": "Binance", "coinbase.com": "Coinbase", "kraken.com": "Kraken",
}
SOCIAL = {
    "instagram.com": "Instagram", "www.instagram.com": "Instagram",
    "facebook.com": "Facebook", "www.facebook.com": "Facebook", "fb.com": "Facebook",
    "tiktok.com": "TikTok", "www.tiktok.com": "TikTok", "twitter.com": "Twitter/X",
    "x.com": "Twitter/X", "linkedin.com": "LinkedIn", "www.linkedin.com": "LinkedIn",
    "reddit.com": "Reddit", "www.reddit.com": "Reddit", "old.reddit.com": "Reddit",
    "youtube.com": "YouTube", "www.youtube.com": "YouTube", "snapchat.com": "Snapchat",
    "www.snapchat.com": "Snapchat", "pinterest.com": "Pinterest",
    "twitch.tv": "Twitch", "www.twitch.tv": "Twitch", "discord.com": "Discord",
    "discord.gg": "Discord", "discordapp.com": "Discord", "telegram.org": "Telegram",
    "t.me": "Telegram", "whatsapp.com": "WhatsApp", "web.whatsapp.com": "WhatsApp",
}
IDENTITY = {
    "accounts.google.com": "Google Auth", "oauth2.googleapis.com": "Google OAuth",
    "login.microsoftonline.com": "Microsoft Auth",
    "login.live.com": "Microsoft Live Auth", "appleid.apple.com": "Apple Auth",
    "auth0.com": "Auth0", "okta.com": "Okta", "onelogin.com": "OneLogin",
    "login.yahoo.com": "Yahoo Auth", "accounts.spotify.com": "Spotify Auth",
}
MAIL = {
    "mail.google.com": "Gmail", "gmail.com": "Gmail", "outlook.com": "Outlook",
    "outlook.live.com": "Outlook", "hotmail.com": "Hotmail",
    "office.com": "Microsoft Office", "microsoft.com": "Microsoft",
    "drive.google.com": "Google Drive", "docs.google.com": "Google Docs",
    "sheets.google.com": "Google Sheets", "slides.google.com": "Google Slides",
    "calendar.google.com": "Google Calendar", "slack.com": "Slack",
    "notion.so": "Notion", "dropbox.com": "Dropbox", "box.com": "Box",
    "trello.com": "Trello", "atlassian.com": "Atlassian", "jira.com": "Jira",
    "confluence.com": "Confluence",
}
BROKER = {
    "acxiom.com": "Acxiom", "liveramp.com": "LiveRamp",
    "oracle.com/cx/marketing/data-cloud": "Oracle Data Cloud",
    "bluekai.com": "Oracle BlueKai", "datalogix.com": "Oracle Datalogix",
    "experian.com": "Experian", "experiandirect.com": "Experian Direct",
    "equifax.com": "Equifax", "transunion.com": "TransUnion",
    "lexisnexis.com": "LexisNexis", "risk.lexisnexis.com": "LexisNexis Risk",
    "epsilon.com": "Epsilon", "merkleinc.com": "Merkle", "towerdata.com": "TowerData",
    "spokeo.com": "Spokeo", "whitepages.com": "Whitepages",
    "beenverified.com": "BeenVerified", "intelius.com": "Intelius",
    "mylife.com": "MyLife", "peoplefinder.com": "PeopleFinder", "pipl.com": "Pipl",
    "thomsonreuters.com": "Thomson Reuters", "criteo.com": "Criteo",
    "taboola.com": "Taboola", "outbrain.com": "Outbrain", "pubmatic.com": "PubMatic",
    "rubiconproject.com": "Rubicon Project", "openx.net": "OpenX",
    "adsrvr.org": "The Trade Desk", "adnxs.com": "Xandr/AppNexus",
    "rlcdn.com": "LiveRamp ATS",
}
GOVERNMENT = {
    "dian.gov.co": "DIAN Colombia", "registraduria.gov.co": "Registraduría Colombia",
    "sisben.gov.co": "SISBEN Colombia", "irs.gov": "IRS US", "gov.uk": "UK Government",
}
RESIDENTIAL_PROXIES = [
    "geosurf.io", "luminati.io", "brightdata.com", "oxylabs.io", "smartproxy.com",
    "iproyal.com", "packetstream.io", "peer2profit.com",
]

# --- fixed values: regional brands (pattern on the host without www.) ---------
ENTITY_PATTERNS = [
    (r"(?i)^amazon\.(com|co\.uk|co\.jp|de|fr|es|it|in|ca|com\.mx|com\.br|com\.au|sg|ae|nl|se|pl|com\.tr|eg|sa)$", "Amazon", "infrastructure"),
    (r"(?i)^(smile\.amazon|sellercentral\.amazon|images-amazon|media-amazon|ssl-images-amazon|completion\.amazon|ecx\.images-amazon|assoc-amazon)\.(com|co\.uk|co\.jp|de|fr|es|it|in|ca)$", "Amazon", "infrastructure"),
    (r"(?i)^(aax|aax-eu|aax-fe)\.amazon-adsystem\.com$", "Amazon Ads", "data_broker"),
    (r"(?i)^(www\.)?google\.(com|co\.uk|co\.jp|de|fr|es|it|ca|com\.au|com\.br|com\.mx|co\.in|com\.ar)$", "Google", "infrastructure"),
    (r"(?i)^(www\.)?facebook\.(com|co\.uk|de|fr|es)$|^(www\.)?instagram\.com$|^fbcdn\.net$|^cdninstagram\.com$", "Meta", "social"),
    (r"(?i)^10xprofit\.io$|^app\.10xprofit\.io$", "10xProfit", "data_broker"),
    (r"(?i)^ecomstal\.(com|io|net)$", "EcomStal", "data_broker"),
]
TWO_LABEL_SUFFIX = r"^(co|com|org|net|gov|edu|ac|sch|me|ne|or)\.[a-z]{2}$"
GOV_PATTERN = r"(?i)\.gov(\.[a-z]{2})?$"

# --- fixed values: order in which the catalogues answer ------------------------
RANK = {
    "infrastructure": 1, "own": 2, "llm": 3, "financial": 4, "social": 5, "identity": 6,
    "mail": 7, "data_broker": 8, "government": 9,
}
# --- fixed values: visit priority, lower first ---------------------------------
VISIT_PRIORITY = {
    "financial": 1, "identity": 2, "data_broker": 3, "llm": 4, "mail": 5, "social": 6,
    "government": 6, "unknown": 7,
}
SENSITIVE = ["financial", "identity", "data_broker", "llm", "mail", "social", "government"]


def _rows():
    best = {}
    sources = [("infrastructure", dict.fromkeys(INFRASTRUCTURE)), ("llm", LLM),
               ("financial", FINANCIAL), ("social", SOCIAL), ("identity", IDENTITY),
               ("mail", MAIL), ("data_broker", BROKER), ("government", GOVERNMENT)]
    for category, members in sources:
        for domain, platform in members.items():
            best.setdefault(domain, (domain, category, platform, RANK[category]))
    return list(best.values())


DOMAIN_ROWS = _rows()

# --- fixed values: URL classification ------------------------------------------
NAMESPACE_HOSTS = ["www.w3.org", "w3.org", "xml.org", "schemas.xmlsoap.org"]
TRUSTED_HOSTS = ["googleapis.com", "gstatic.com", "mozilla.org", "microsoft.com"]
ANALYTICS_HOSTS = ["google-analytics.com", "googletagmanager.com", "segment.io", "mixpanel.com", "sentry.io"]
BAD_TLDS = ["zip", "mov", "top", "xyz", "click", "cam", "icu", "cyou"]
LITERAL_NAMESPACES = ["www.w3.org", "xml.org", "schemas.xmlsoap.org"]
URL_POINTS = {"non_https": 2, "raw_ip": 5, "suspicious_tld": 3, "dynamic": 2}
EXTERNAL_CLASSES = ["unknown", "suspicious_tld", "raw_ip", "non_https", "dynamic"]
SUSPICIOUS_CLASSES = ["suspicious_tld", "raw_ip", "non_https", "dynamic"]

# --- fixed values: social platform traces used by the ad-injection rule ---------
PLATFORM_TRACES = {
    "Facebook/Instagram": ["facebook.com", "graph.facebook.com", "fbcdn.net", "instagram.com", "cdninstagram.com"],
    "Twitter/X": ["twitter.com", "x.com", "api.twitter.com", "twimg.com", "/i/api/"],
    "TikTok": ["tiktok.com", "musical.ly", "tiktokcdn.com", "tiktokv.com", "/api/aweme/", "aweme.snssdk.com", "musical_ly"],
    "LinkedIn": ["linkedin.com", "licdn.com", "/voyager/api/"],
    "Pinterest": ["pinterest.com", "pinimg.com", "/v3/pidgets/"],
    "YouTube": ["youtube.com", "ytimg.com", "/youtubei/v1/"],
    "Snapchat": ["snapchat.com", "sc-cdn.net", "snap.com"],
    "Reddit": ["reddit.com", "redd.it", "redditmedia.com"],
    "Twitch": ["twitch.tv", "twitchsvc.net", "jtvnw.net"],
}

# --- fixed values: store categories, first hit wins ------------------------------
STORE_CATEGORIES = [
    "Accessibility", "Art & Design", "Communication", "Developer Tools", "Entertainment",
    "News & Weather", "Productivity", "Privacy & Security", "Search Tools", "Shopping",
    "Social & Communication", "Sports", "Travel", "Well-being", "Fun", "Games",
]
