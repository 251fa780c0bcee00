"""Lookup values and patterns. All are fixed values that results depend on."""

from __future__ import annotations

# Languages known to the catalog (ISO codes).
LANGUAGES = [
    "sq", "hy", "eu", "be", "bs", "br", "bg", "ca", "hr", "cs", "da", "nl", "en", "et", "fo", "fi", "fr",
    "fy", "gl", "ka", "de", "el", "hu", "is", "ga", "it", "lv", "lt", "lb", "mk", "mt", "se", "no", "pl",
    "pt", "ro", "rm", "gd", "sr", "sk", "sl", "es", "sv", "tr", "uk", "cy",
]
CYRILLIC_LANGUAGES = ["be", "bg", "mk", "sr", "uk"]

# URL suffixes of media, archive, office and asset files.
RESOURCE_SUFFIXES = [
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico", "tiff", "tif",
    "mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "m4v", "mpg", "mpeg",
    "mp3", "wav", "ogg", "m4a", "flac", "aac", "wma",
    "pdf", "zip", "rar", "7z", "tar", "gz", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "css", "js", "xml", "json", "csv",
]

# Subtrees without content, and content roots in order of preference.
# A selector is (tag or "*", attribute or None, "=" or "~", value).
BOILERPLATE_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "iframe"]
PLAIN_SELECTORS = [
    ("main", None, "", ""), ("article", None, "", ""),
    ("*", "id", "=", "main"), ("*", "id", "=", "content"),
    ("div", "id", "=", "main"), ("div", "id", "=", "content"),
    ("div", "class", "~", "dce"), ("div", "class", "~", "tx-"),
    ("div", "class", "~", "content"), ("div", "class", "~", "main"),
    ("body", None, "", ""),
]
RENDERED_SELECTORS = [
    ("main", None, "", ""), ("article", None, "", ""),
    ("*", "id", "=", "main"), ("*", "id", "=", "content"),
    ("div", "id", "=", "main"), ("div", "id", "=", "content"),
    ("div", "id", "=", "__nuxt"), ("div", "id", "=", "__layout"),
    ("div", "id", "=", "app"), ("div", "id", "=", "__next"),
    ("div", "class", "=", "nuxt-content"), ("div", "class", "=", "container"),
    ("div", "class", "~", "dce"), ("div", "class", "~", "tx-"),
    ("div", "class", "~", "content"), ("div", "class", "~", "main"),
    ("body", None, "", ""),
]

# Domain cues. Property names are a parameter of the caller ("names").
DOMAIN_CUES = {
    "contains": [
        "hotel", "wellness", "unterkunft", "хотел", "sauna", "hamam", "jacuzzi", "whirlpool",
        "massag", "kulinar", "urlaub", "pauschale", "piste", "adults", "halfboard", "halbpension", "ferien",
    ],
    "exact": [
        "spa", "resort", "albergo", "lodging", "accommodation", "hike", "hiking", "reiten", "reiter",
        "ski", "schi",
    ],
    "prefix": [
        "skifahr", "skiurlaub", "skilift", "skipiste", "skigebiet", "skihotel", "skisport", "skiin", "skiout",
        "skiraum", "schifahr", "schiurlaub", "schilift", "schipiste", "schigebiet", "schihotel", "schisport",
        "schiraum",
        "wandern", "wanderung", "wanderweg", "wanderhotel",
        "reiten", "reithalle", "reitstall", "reitsport", "reiturlaub", "reiterhof", "reitangebot",
    ],
    "names": [],
}

# Regions in match order, with aliases.
REGIONS = [
    ("Tirol", ["tirol", "tyrol", "tyrolen"]),
    ("Salzburg", ["salzburg", "salzburger land", "salzburgerland"]),
    ("Kärnten", ["kärnten", "karnten", "carinthia", "carinthien"]),
    ("Steiermark", ["steiermark", "styria"]),
    ("Vorarlberg", ["vorarlberg"]),
    ("Oberösterreich", ["oberösterreich", "oberoesterreich", "upper austria"]),
    ("Niederösterreich", ["niederösterreich", "niederoesterreich", "lower austria"]),
    ("Wien", ["wien", "vienna"]),
    ("Bayern", ["bayern", "bavaria", "bayerischen alpen"]),
    ("Südtirol", ["südtirol", "sudtirol", "south tyrol", "alto adige"]),
    ("Trentino", ["trentino"]),
]

# Turn patterns (alternatives between word boundaries).
DEICTIC = [
    "dort", "dazu", "davon", "darüber", "darueber", r"dieses\s+hotel", r"diesem\s+hotel", r"dem\s+hotel",
    r"that\s+hotel", r"this\s+hotel", "there", r"the\s+hotel",
]
MULTI_TENANT = [
    r"zu\s+welchen\s+hotels?", r"welche\s+hotels?", r"in\s+welchen\s+hotels?",
    r"which\s+hotels?", r"what\s+hotels?", r"among\s+(?:the\s+)?hotels?",
]
BROAD_CATALOG = [
    r"kennst\s+du\s+hotels?", r"welche\s+hotels?\s+(?:kennst|gibt|habt|sind)", r"welche\s+hotels?",
    r"zeig\s+mir\s+(?:alle\s+)?hotels?", r"alle\s+hotels?", r"liste?\s+(?:all\s+)?hotels?",
    r"which\s+hotels?\s+(?:do\s+you\s+know|are\s+there|have\s+you)",
    r"what\s+hotels?\s+(?:do\s+you\s+know|are\s+available)", r"show\s+me\s+(?:all\s+)?hotels?",
    r"hotels?\s+in\s+(?:der\s+datenbank|your\s+database)",
]
MORE_SOURCES = [r"weitere\s+quellen", r"more\s+sources", r"additional\s+sources"]
STRONG_FILTERS = [
    "sauna", "pool", "whirlpool", "spa ", " spa", "massage", "yoga", "adults", "hund", "dog", "pet",
    "ski", "schi", "halbpension", "all inclusive", "familie", "family", "kinder", "children", "budget",
    "preis", "günstig", "luxus", "luxury", "therme", "golf", "e-auto", "ladestation", "elektro",
]
SKI_WORDS = ["ski", "schi"]
PLACEHOLDER_FOOTER = r"(?i)(?:\r?\n---\s*)?\r?\n\*\*(?:Quellen|Sources):\*\*\s*(?:\r?\n\s*\[to be done\]\s*)+"
SOURCE_BLOCK = r"(?is)\*\*(?:Quellen|Sources):\*\*.*https?://"

# Language policy words and thresholds.
POLICY_CUES = ["hotel", "hotels", "wellness", "spa", "sauna", "pool", "zimmer", "room", "ski", "piste",
               "urlaub", "vacation", "holiday", "resort"]
CORE_LANGUAGES = ["de", "en", "nl", "it", "fr"]
GERMAN_MARKERS = ["mit", "und", "bei", "für", "fur", "auch", "nicht", "im", "einen", "einem", "einer", "ich",
                  "suche", "gibt", "welche", "welches", "welcher", "ohne", "über", "ueber"]
SHARED_WORDS = ["hotel", "hotels", "hôtel", "spa", "wellness", "pool", "sauna", "salzburg", "tirol", "tyrol",
                "kärnten", "karnten", "carinthia", "steiermark", "vorarlberg", "wien", "vienna", "bayern",
                "bavaria", "in", "with", "and", "the", "a", "an", "near", "adults", "only", "dogs", "family"]
MIN_CANDIDATE = 0.10
CLOSE_MARGIN = 0.15
CLOSE_RATIO = 0.50
STICKY_MIN = 0.12
MAX_CLOSE = 4
AFFIRMATIVES = ["ja", "yes", "oui", "sí", "si", "ok", "okay", "gerne", "sure", "jo", "yep", "yeah",
                "ja bitte", "yes please", "bitte"]
# Names by which a caller may choose a language.
CHOICE_NAMES = [
    ("de", ["deutsch", "german", "allemand", "tedesco", "duits", "alemán", "aleman", "német", "niemiecki",
            "německy", "nemecko"]),
    ("en", ["english", "englisch", "anglais", "inglese", "inglés", "ingles", "engels", "angol", "angielski",
            "anglicky"]),
    ("nl", ["nederlands", "dutch", "niederländisch", "niederlandisch", "holländisch", "hollandisch", "flemish",
            "flämisch", "flaemisch", "vlaams", "flamand", "fiammingo"]),
    ("fr", ["français", "francais", "french", "französisch", "franzosisch", "francese", "francés"]),
    ("it", ["italiano", "italian", "italienisch", "italien"]),
    ("es", ["español", "espanol", "spanish", "spanisch", "spagnolo", "castellano"]),
    ("pt", ["português", "portugues", "portuguese", "portugiesisch"]),
    ("pl", ["polski", "polish", "polnisch"]),
    ("cs", ["čeština", "cestina", "czech", "tschechisch"]),
    ("sk", ["slovenčina", "slovencina", "slovak", "slowakisch"]),
    ("sl", ["slovenščina", "slovenscina", "slovene", "slowenisch"]),
    ("hr", ["hrvatski", "croatian", "kroatisch"]),
    ("hu", ["magyar", "hungarian", "ungarisch"]),
    ("ro", ["română", "romana", "romanian", "rumänisch"]),
    ("sv", ["svenska", "swedish", "schwedisch"]),
    ("da", ["dansk", "danish", "dänisch", "daenisch"]),
    ("no", ["norsk", "norwegian", "norwegisch"]),
    ("fi", ["suomi", "finnish", "finnisch"]),
    ("el", ["ελληνικά", "greek", "griechisch"]),
    ("tr", ["türkçe", "turkce", "turkish", "türkisch"]),
    ("uk", ["українська", "ukrainian", "ukrainisch"]),
    ("bg", ["български", "bulgarian", "bulgarisch"]),
    ("sr", ["српски", "serbian", "serbisch"]),
    ("bs", ["bosanski", "bosnian", "bosnisch"]),
    ("mk", ["македонски", "macedonian", "mazedonisch"]),
    ("sq", ["shqip", "albanian", "albanisch"]),
    ("et", ["eesti", "estonian", "estnisch"]),
    ("lv", ["latviešu", "latvian", "lettisch"]),
    ("lt", ["lietuvių", "lithuanian", "litauisch"]),
    ("ga", ["gaeilge", "irish", "irisch"]),
    ("cy", ["cymraeg", "welsh", "walisisch"]),
    ("is", ["íslenska", "icelandic", "isländisch"]),
    ("mt", ["malti", "maltese", "maltesisch"]),
    ("ca", ["català", "catalan", "katalanisch"]),
    ("gl", ["galego", "galician", "galicisch"]),
    ("eu", ["euskara", "basque", "baskisch"]),
    ("lb", ["lëtzebuergesch", "luxembourgish", "luxemburgisch"]),
    ("fy", ["frysk", "frisian", "friesisch", "westfriesisch"]),
    ("rm", ["rumantsch", "romansh", "rätoromanisch"]),
    ("be", ["беларуская", "belarusian", "weißrussisch"]),
    ("hy", ["հայերեն", "armenian", "armenisch"]),
    ("ka", ["ქართული", "georgian", "georgisch"]),
]

# Distance patterns, radii and the gazetteer (name, kind, lat, lng, aliases).
PROXIMITY = [
    r"so\s+nah\s+(?:wie|an)", r"möglichst\s+nah", r"geringste\s+entfernung", r"beste\s+nähe", r"nähe\s+zu",
    r"nah(?:e|er)?\s+(?:an|bei|zu)", r"nah(?:e|er)?", r"in\s+der\s+nähe", "unweit", r"nächst(?:e|en|er|es)?",
    "stadtnah", "closest", "nearest", r"near(?:est)?(?:\s+to)?", r"close\s+to", r"as\s+close\s+as",
]
LIFT_AT_DOOR = [
    "ski-?in", "ski-?out", r"ski\s+in\s+ski\s+out", r"skilift\s+vor", r"ski\s*lift\s+vor", r"lift\s+vor\s+dem",
    r"direkt(?:er|em)?\s+zugang\s+zum\s+(?:ski)?lift", r"ski\s+an\s+der\s+haustür",
    r"ski\s+an\s+der\s+haustuer", r"ski\s+to\s+the\s+door", r"lift\s+in\s+front",
]
UNNAMED_SKI_AREA = ["skigebiet", r"ski\s*resort", r"ski\s*area", r"nähe\s+zu\s+einem\s+skigebiet",
                    r"nahe\s+(?:einem\s+)?skigebiet"]
EARTH_KM = 6371.0
CLOSE_CITY_KM = 25.0
CLOSE_SKI_KM = 20.0
NEAREST_SKI = "Skigebiet"
CITY_WORD = ("salzburg", "Salzburg-Stadt", ["salzburger land", "salzburgerland"])
PLACES = [
    ("Salzburg-Stadt", "City", 47.7982, 13.0465,
     ["salzburg-stadt", "salzburg stadt", "stadt salzburg", "salzburger altstadt", "salzburg city",
      "salzburg old town", "salzburg centre", "salzburg center"]),
    ("Innsbruck", "City", 47.2692, 11.4041, ["innsbruck"]),
    ("München", "City", 48.1374, 11.5755, ["münchen", "muenchen", "munich"]),
    ("Wien", "City", 48.2082, 16.3738, ["wien", "vienna"]),
    ("Zell am See", "City", 47.3233, 12.7967, ["zell am see"]),
    ("Zell am Ziller", "City", 47.2336, 11.8808, ["zell am ziller", "zell im zillertal"]),
    ("Kitzbühel", "City", 47.4467, 12.3922, ["kitzbühel", "kitzbuehel", "kitzbuhel"]),
    ("Fuschl", "City", 47.7964, 13.3028, ["fuschl", "fuschlsee"]),
    ("Mondsee", "City", 47.8564, 13.3508, ["mondsee"]),
    ("Berchtesgaden", "City", 47.6303, 13.0011, ["berchtesgaden", "berchtesgadener land"]),
    ("Bergheim", "City", 47.8397, 13.0228, ["bergheim"]),
    ("Flughafen Salzburg", "Place", 47.7933, 13.0043, ["flughafen salzburg", "salzburg airport", "szg"]),
    ("Flughafen Innsbruck", "Place", 47.2602, 11.3439, ["flughafen innsbruck", "innsbruck airport"]),
    ("Flughafen München", "Place", 48.3538, 11.7861,
     ["flughafen münchen", "flughafen muenchen", "munich airport", "muc"]),
    ("Skicircus Saalbach", "SkiArea", 47.3910, 12.6360,
     ["saalbach", "hinterglemm", "skicircus", "saalbach-hinterglemm"]),
    ("Großarltal", "SkiArea", 47.2374, 13.2009,
     ["großarl", "grossarl", "großarltal", "grossarltal", "dorfgastein"]),
    ("Hochkönig", "SkiArea", 47.3853, 13.0028, ["hochkönig", "hochkoenig", "dienten"]),
    ("Zillertal 3000", "SkiArea", 47.1680, 11.8640, ["zillertal 3000", "finkenberg", "mayrhofen", "hintertux"]),
    ("Zillertal Arena", "SkiArea", 47.2336, 11.8808, ["zillertal arena"]),
    ("Zugspitz Arena", "SkiArea", 47.4014, 10.8796, ["zugspitz arena", "lermoos", "grubigstein"]),
    ("Tannheimertal", "SkiArea", 47.5006, 10.5563, ["tannheimertal", "tannheim", "grän", "graen"]),
    ("Turracher Höhe", "SkiArea", 46.9140, 13.8758, ["turracher höhe", "turracher hoehe", "turrach"]),
    ("Warth-Schröcken", "SkiArea", 47.2583, 10.1836, ["warth", "schröcken", "schroecken", "arlberg"]),
    ("Seefeld", "SkiArea", 47.3306, 11.1870, ["seefeld"]),
    ("Ötztal", "SkiArea", 46.9670, 10.9750,
     ["ötztal", "oetztal", "sölden", "soelden", "längenfeld", "laengenfeld"]),
    ("Alpbachtal", "SkiArea", 47.3986, 11.9428, ["alpbach", "alpbachtal"]),
    ("Achensee/Rofan", "SkiArea", 47.4250, 11.7548, ["achensee", "rofan", "maurach"]),
    ("Kitzbühel Ski", "SkiArea", 47.4467, 12.3922, ["kitzbüheler alpen"]),
    ("Kaprun", "SkiArea", 47.2725, 12.7597, ["kaprun"]),
    ("Leogang", "SkiArea", 47.4394, 12.7610, ["leogang"]),
]

NOT_AVAILABLE = "not available"


def bounded(alternatives: list[str]) -> str:
    """A case-insensitive Unicode-aware pattern: one of the alternatives as whole words."""
    return r"(?iU)\b(?:" + "|".join(alternatives) + r")\b"
