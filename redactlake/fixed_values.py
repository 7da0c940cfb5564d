"""Fixed values.

Everything in this file has to equal published formats or the behaviour users already rely on: type names,
priorities, match patterns, word lists, the IBAN length table, limits and line layouts. Patterns are written in
the RE2 dialect; ``functions.patterns`` turns them into what Spark's (Java) regex engine needs.
"""

# --- types in registration order, with the priority that decides overlaps -------------------------------------
PII_TYPES = [
    "SECRET",
    "URL_SECRET",
    "EMAIL",
    "PHONE",
    "CREDIT_CARD",
    "IBAN",
    "PERSONAL_ID",
    "SOCIAL_SECURITY",
    "TAX_ID",
    "VAT_ID",
    "KVNR",
    "LICENSE_PLATE",
    "DRIVER_LICENSE",
    "ADDRESS",
]

PRIORITY = {
    "SECRET": 6,
    "URL_SECRET": 6,
    "CREDIT_CARD": 5,
    "IBAN": 5,
    "KVNR": 5,
    "SOCIAL_SECURITY": 5,
    "DRIVER_LICENSE": 4,
    "EMAIL": 4,
    "PERSONAL_ID": 4,
    "TAX_ID": 4,
    "VAT_ID": 4,
    "LICENSE_PLATE": 3,
    "PHONE": 3,
    "ADDRESS": 2,
}

# --- match patterns -------------------------------------------------------------------------------------------
EMAIL = r"(?i)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE = (
    r"(?:(?:\+|00)(?:49|43|41)[\s()\-]*(?:\(0\)[\s()\-]*)?\d[\d\s()\-]{5,16}\d"
    r"|0[1-9]\d[\d\s\-/]{5,13}\d)"
)
CREDIT_CARD = (
    r"\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{4}[ \-]\d{6}[ \-]\d{4}|\d{13,19}"
)
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9 ]{11,31}\b"
TAX_ID = r"\b[1-9]\d(?: ?\d{3}){3}\b"
SOCIAL_SECURITY = r"\b\d{2} ?\d{6} ?[A-Z] ?\d{3}\b"
KVNR = r"\b[A-Z][0-9]{9}\b"
VAT_ID = r"\bDE ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b"
PERSONAL_ID = r"\b[A-Z][A-Z0-9]{8}\b"
PLATE_HYPHEN = r"\b([A-ZÄÖÜ]{1,3})-([A-Z]{1,2}) ?([1-9][0-9]{0,3}[EH]?)\b"
PLATE_SPACE = r"\b([A-ZÄÖÜ]{1,3}) ([A-Z]{1,2}) ([1-9][0-9]{0,3}[EH]?)\b"
DRIVER_LICENSE = r"\b[A-Z]{1,3}[0-9]{6}[A-Z0-9]{2}\b"
DRIVER_CONTEXT = (
    r"(?i)f[uü]hrerschein|fahrerlaubnis|fs[-\s]?nr|driver\s+licen[sc]e|driving\s+licen[sc]e"
)
DRIVER_CONTEXT_BYTES = 200

# --- address vocabulary ---------------------------------------------------------------------------------------
STREET_SUFFIXES = """
    acker allee anger aue avenue bach berg bogen boulevard breite bruck brück brücke burg bühel bühl büel chaussee
    damm egg feld forst garten gasse graben grund grün gaessli gärtle gärtli gässchen gäßchen gässle gäßle gässli
    hafen halde hang hecke heide hof holz horst höhe kai kamp lehen leiten lände markt matte mauer moos mühle park
    pfad platz promenade quai rain ried riet ring rotte runde schanze schlag siedlung staffel stall steg steig
    steige stieg stiege str strasse straße stutz tal thal tor trift turm ufer warte weg weid wiese winkel zeile
""".split()

STREET_PREPOSITIONS = [
    "Am", "An dem", "An den", "An der", "An die",
    "Auf dem", "Auf den", "Auf der", "Auf die",
    "Bei dem", "Bei den", "Bei der", "Beim",
    "Hinter dem", "Hinter den", "Hinter der", "Hinter die",
    "Im", "In dem", "In den", "In der", "In die",
    "Neben dem", "Neben der",
    "Ob dem", "Ob der",
    "Unter dem", "Unter den", "Unter der", "Unter die",
    "Vor dem", "Vor den", "Vor der", "Vor die",
    "Zu den", "Zum", "Zur",
]

# --- IBAN lengths by country (IBAN registry) ------------------------------------------------------------------
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NI": 32, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# --- secret rules: our own, from publicly documented token formats --------------------------------------------
# (rule id, pattern, literals of which a text with a match holds one, confidence); the generic rule reports group 1 only
SECRET_RULES = [
    ("aws-access-key-id", r"\bAKIA[0-9A-Z]{16}\b", ["AKIA"], 1.0),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", ["gho_", "ghp_", "ghr_", "ghs_", "ghu_"], 1.0),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", ["xox"], 1.0),
    ("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}", ["AIza"], 1.0),
    ("stripe-key", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", ["k_live_", "k_test_"], 1.0),
    ("jwt", r"(?:^|[^\w-])(eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+)", ["eyJ"], 1.0),
    ("pem-private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ["PRIVATE KEY-----"], 1.0),
]
GENERIC_SECRET_RULE = "generic-assignment"
GENERIC_SECRET = (
    r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b\s*[:=]\s*[\"']?([A-Za-z0-9_+/=.-]{16,})"
)
GENERIC_SECRET_CONFIDENCE = 0.8
URL_SECRET_KEYS = [
    "access_token", "api_key", "apikey", "auth", "key", "passwd", "password", "pwd", "secret", "session", "sig",
    "signature", "token",
]
URL_SECRET = r"(?i)[?&](?:" + "|".join(URL_SECRET_KEYS) + r")=([^&#\s\x00-\x1f\"'<>]+)"
URL_SECRET_CONFIDENCE = 0.9

# --- traffic and logs -----------------------------------------------------------------------------------------
CALLS_PER_MINUTE = 120
LOG_TAIL_LINES = 150
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
LOG_LINE_FORMAT = "%s  %-6s %-30s  %d  %5d B  %s"
BINARY_PLACEHOLDER = "<binary>"
DEFAULT_POLICY_PORT = 8080
# white space as trimmed from whitelist tokens
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# --- the address pattern in its plain form, a fixed value like the patterns above; longest words first ------------------
def address_pattern() -> str:
    """For checks and tests; `functions/patterns.py` restates it for linear time."""
    by_length = lambda words: "|".join(sorted(words, key=lambda w: -len(w.encode())))
    return (
        rf"(?i)(?:(?:{by_length(STREET_PREPOSITIONS)})\s+)?(?:[A-ZÄÖÜ][a-zäöüß]+(?:[-][A-ZÄÖÜ]?[a-zäöüß]+)*)[-\s]*"
        rf"(?:{by_length(STREET_SUFFIXES)})\.?\s+(?:\d+\s*[a-zA-Z]?(?:\s*/\s*\d+)?),?\s+(?:\d{{5}}|\d{{4}})\s+"
        r"(?:[A-ZÄÖÜ][a-zäöüß]+(?:(?:\s+|-)[A-ZÄÖÜ]?[a-zäöüß]+){0,2})"
    )
