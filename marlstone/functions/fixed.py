"""Words that pages, players and failed fetches use. Results depend on them as they are."""

#: Parts of titles that aren't a page's own.
TITLE_NOISE = ["subscribe", "newsletter", "sign in", "log in", "cookie", "privacy", "terms", "advertisement"]
#: What a player's or a caption menu's interface says.
INTERFACE = [
    "video player is loading", "this is a modal window", "beginning of dialog window", "end of dialog window", "escape will cancel and close the window", "text color", "text background color", "caption",
    "caption area", "background color", "opacity", "font size", "font family", "text edge", "edge style", "drop shadow", "raised", "depressed", "uniform", "proportional", "sans-serif", "monospace", "serif",
    "semi-transparent", "transparent", "opaque", "white", "black", "red", "green", "blue", "yellow", "magenta", "cyan",
]
COLORS = ["white", "black", "red", "green", "blue", "yellow", "magenta", "cyan"]
#: A menu's label and its value without a blank between them.
GLUED = r"(?i)(Text\s*Color|Opacity|Font\s*Size|Font\s*Family|Text\s*Background\s*Color|Caption\s*Area\s*Background\s*Color)(White|Black|Red|Green|Blue|Yellow|Magenta|Cyan|Opaque|Transparent|Semi-Transparent|\d{1,3}%|\w+)"
#: What stands around an article.
INLINE_NOISE = [
    "sign up", "sign in", "log in", "create account", "subscribe", "newsletter", "unlock unlimited access", "privacy policy", "terms of service", "cookie policy", "all rights reserved", "copyright",
    "advertisement", "sponsored", "promo code", "use code", "watch live", "live:", "listen", "share", "copy link", "print", "report", "support the investigative reporting", "vip access",
]
SEE_ALL = r"(?i)^(see|view|show)\s+(all|more)\b"
TABLE_SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
#: Words as they are counted in lines: ASCII letters and digits, common Han characters.
WORDLIKE = r"[A-Za-z0-9一-鿿]+"
#: Markers of a failed fetch, by the stage that failed.
FAILED_CONNECT = ["connecttimeout", "connecterror", "all connection attempts failed", "connection refused", "name or service not known", "temporary failure in name resolution", "nxdomain", "dns"]
FAILED_READ = ["readtimeout", "read timeout", "timed out while reading"]
FAILED_HTTP = ["http_", "status=", "403", "429", "500", "502", "503", "504"]
