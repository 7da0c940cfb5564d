"""Regular expressions for Spark's Java engine, built from the RE2-dialect fixed values.

Java differs where it matters here: ``\\b`` knows Unicode letters, ``\\s`` includes the vertical tab, and matching
backtracks. The two patterns that could backtrack badly on long texts (EMAIL, ADDRESS) are restated so that each
stretch of text is walked a bounded number of times; the matches stay the same.
"""

from __future__ import annotations

import re
import string

from redactlake import fixed_values as fv

SPACE = r"\t\n\f\r "
# letters whose simple case folding lands on ASCII s and k
FOLDED = "\u017f\u212a"
# Java's \w, \d and \p{Alpha} are ASCII and one table look-up each, where ranges are tried one by one
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"
EDGE = rf"(?:(?<=\w){WORD_END}|{WORD_START}(?=\w))"


def to_java(pattern: str, ends_in_word: bool = True) -> str:
    """Translate an RE2 pattern: ASCII word edges, ASCII white space, Unicode case folding.

    A leading edge before a character that is a word character by itself becomes a look-behind after that character:
    then the search skips from one such character to the next. A last edge only looks ahead, unless the pattern can
    end in something else than a word character.
    """
    out = pattern.replace("(?i)", "(?iu)")
    leading = re.match(r"\\b(\[[0-9A-Za-z\-]+\]|\\d|[A-Za-z])(?:\{(\d+)(?:,(\d+))?\})?", out)
    if leading:
        first, low, high = leading[1], int(leading[2] or 1), int(leading[3] or leading[2] or 1)
        more = f"{first}{{{low - 1},{high - 1}}}" if high > 1 else ""
        out = rf"{first}(?<!\w.){more}{out[leading.end() :]}"
    if ends_in_word and out.endswith(r"\b"):
        out = out[:-2] + WORD_END
    out = out.replace(r"\b", EDGE)
    parts, in_class, i = [], False, 0
    while i < len(out):
        two = out[i : i + 2]
        if two == r"\s":
            parts.append(SPACE if in_class else f"[{SPACE}]")
            i += 2
            continue
        if out[i] == "\\":
            parts.append(two)
            i += 2
            continue
        if out[i] in "[]":
            in_class = out[i] == "["
        parts.append(out[i])
        i += 1
    return "".join(parts)


def _email() -> str:
    """A match can only begin at the first word edge of a run of local-part characters, or right after the previous
    match (which ends at an edge): any later edge of the run leads to the same character after the run. Later edges are
    skipped, so a run is walked once instead of once per edge."""
    local = rf"\w.%+\-{FOLDED}"
    marks = rf".%+\-{FOLDED}"
    domain = rf"\p{{Alnum}}.\-{FOLDED}"
    first_edge = rf"(?<!\w.)(?<=\w)(?<!\w[{marks}]{{1,8}}.)"
    after_match = r"(?<=\G.)(?<=[\s\S].)"
    return rf"[{local}](?:{first_edge}|{after_match})[{local}]*+@[{domain}]+\.[\p{{Alpha}}{FOLDED}]{{2,}}{EDGE}"


def _plate(separator: str, before_number: str) -> str:
    """Umlauts are no word characters, so the edge before them needs a word character in front."""
    edge = r"(?:(?<=[A-Z])(?<!\w.)|(?<=\w[ÄÖÜ]))"
    return rf"[\p{{Upper}}ÄÖÜ]{edge}[A-ZÄÖÜ]{{0,2}}{separator}[A-Z]{{1,2}}{before_number}[1-9][0-9]{{0,3}}[EH]?{WORD_END}"


def _longest_first(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _address() -> str:
    """[preposition] name suffix[.] number[letter][/n][,] 4-5 digits, city of one to three words, ignoring case.

    Rests on three facts: a name may begin mid-word only behind a preposition, since otherwise the same match also
    begins one letter earlier; the suffix has to end a run of letters, because a dot or white space follows; and
    names hold single hyphens only, double ones can stand just before the suffix. The look-ahead rejects nearly every
    word (no number follows) before any suffix is tried."""
    ws = f"[{SPACE}]"
    first = rf"\p{{Alpha}}ÄÖÜäöü{FOLDED}"
    letter = f"{first}ßẞ"
    ascii_letter = rf"[\p{{Alpha}}{FOLDED}]"
    suffix = f"(?iu:{_longest_first(fv.STREET_SUFFIXES)})"
    preposition = f"(?=[AaBbHhIiNnOoUuVvZz][BbEeIiMmNnOoUu])(?iu:{_longest_first(fv.STREET_PREPOSITIONS)}){ws}++"
    begin = rf"(?:{preposition}|(?:\G|(?<![{first}])))"
    number_ahead = rf"(?=[{first}][{letter}][{letter}\-]*+(?:[\-{SPACE}]++[{letter}]++)?+\.?{ws}++[0-9])"
    single_hyphens = rf"(?![{letter}\-]*?--)[{first}][{letter}][{letter}\-]*{suffix}"
    double_hyphen = rf"[{first}][{letter}](?>[{letter}\-]*?--)-*+{suffix}"
    two_words = rf"(?![{letter}\-]*?--[{letter}])[{first}][{letter}][{letter}\-]*+{ws}[\-{SPACE}]*+{suffix}"
    house = (
        rf"(?:[0-9]++(?:{ws}*+{ascii_letter}(?:{ws}*+/{ws}*+[0-9]++)?+|{ws}*+/{ws}*+[0-9]++)?+,?+|[0-9]++{ws}*+,)"
    )
    city = rf"[{first}][{letter}]++(?:(?:{ws}++|-)[{letter}]++){{0,2}}+"
    return (
        rf"{begin}{number_ahead}(?:{single_hyphens}|{double_hyphen}|{two_words})"
        rf"\.?{ws}++{house}{ws}++[0-9]{{4,5}}+{ws}++{city}"
    )


PATTERNS = {
    "EMAIL": _email(),
    "PHONE": "(?=[0+])" + to_java(fv.PHONE),
    # all forms begin with four digits
    "CREDIT_CARD": r"\d{4}(?:[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|[ \-]\d{6}[ \-]\d{5}|[ \-]\d{6}[ \-]\d{4}|\d{9,15})",
    "IBAN": to_java(fv.IBAN, ends_in_word=False),
    "PERSONAL_ID": to_java(fv.PERSONAL_ID),
    "SOCIAL_SECURITY": to_java(fv.SOCIAL_SECURITY),
    "TAX_ID": to_java(fv.TAX_ID),
    "VAT_ID": to_java(fv.VAT_ID),
    "KVNR": to_java(fv.KVNR),
    "PLATE_HYPHEN": _plate("-", " ?"),
    "PLATE_SPACE": _plate(" ", " "),
    "DRIVER_LICENSE": to_java(fv.DRIVER_LICENSE),
    "DRIVER_CONTEXT": to_java(fv.DRIVER_CONTEXT),
    "ADDRESS": _address(),
    "GENERIC_SECRET": "(?=[aApPsStT\u017f])" + to_java(fv.GENERIC_SECRET),
    # a token begins where no token character precedes, so a run of such characters is walked once
    "jwt": r"e(?<![\w-]e)yJ[\w-]++\.eyJ[\w-]++\.[\w-]++",
    # for the value inside a match, which has no text before it
    "GENERIC_SECRET_VALUE": to_java(fv.GENERIC_SECRET.replace(r"\b", "", 1)),
    "URL_SECRET": to_java(fv.URL_SECRET),
}

# Cheap conditions that every text with a match meets. They stop at the first place that fits and spare all other
# texts the find-all pass.
GATES = {
    "PHONE": r"[0+](?:04[139]|4[139]|[1-9][0-9])",
    "CREDIT_CARD": r"[0-9]{4}(?:[0-9]{9}|[ \-][0-9]{4}(?:[ \-]|[0-9]{2}[ \-]))",
    "IBAN": r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}",
    "PERSONAL_ID": r"[A-Z][A-Z0-9]{8}",
    "SOCIAL_SECURITY": r"[0-9]{6} ?[A-Z] ?[0-9]{3}",
    "TAX_ID": r"[1-9][0-9] ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}",
    "VAT_ID": r"DE ?[0-9]{3} ?[0-9]{3}",
    "KVNR": r"[A-Z][0-9]{9}",
    "PLATE_HYPHEN": r"[A-ZÄÖÜ]-[A-Z]{1,2} ?[1-9]",
    "PLATE_SPACE": r"[A-ZÄÖÜ] [A-Z]{1,2} [1-9]",
    "DRIVER_LICENSE": r"[A-Z][0-9]{6}[A-Z0-9]{2}",
    "ADDRESS": (
        rf"[0-9][{SPACE}]*+[A-Za-z{FOLDED}]?+[{SPACE}]*+,?+[{SPACE}]*+"
        rf"(?<=[{SPACE}])[0-9]{{4,5}}+[{SPACE}]++[A-Za-zÄÖÜäöü{FOLDED}]"
    ),
    "GENERIC_SECRET": rf"[:=][{SPACE}]*+[\"']?+[A-Za-z0-9_+/=.\-{FOLDED}]{{16}}",
    "URL_SECRET": rf"[?&][A-Za-z_{FOLDED}]++=",
}

# Conditions shared by several detectors, tried first: most texts fail them, and then one pass over the text stands
# for up to five. Each begins with one character class, which Java scans far faster than alternatives.
SHARED_GATES = {
    # eight digits with nothing but separators between them
    "digits": rf"[0-9](?:[{SPACE}()/\-]*+[0-9]){{7}}",
    # what identity codes, bank codes and plates begin with
    "capitals": r"[\p{Upper}ÄÖÜ](?:[A-Z0-9]{8}|[A-Z][0-9]{2}[A-Z0-9 ]{11}|[- ][A-Z]{1,2} ?[1-9])",
}
SHARED_GATE_OF = {
    "PHONE": "digits",
    "CREDIT_CARD": "digits",
    "TAX_ID": "digits",
    "SOCIAL_SECURITY": "digits",
    "VAT_ID": "digits",
    "IBAN": "capitals",
    "PERSONAL_ID": "capitals",
    "KVNR": "capitals",
    "LICENSE_PLATE": "capitals",
    "DRIVER_LICENSE": "capitals",
}

# What lies near enough to a core to have a part in a match: texts are cut down to that before they are searched.

# Every match of these types lies within one run of such characters, four at least, and begins with one that no separator is. A class of
# single characters is one table look-up in Java, where ranges are tried one by one.
RUN_START = string.digits + string.ascii_uppercase + "ÄÖÜ+"
RUN_CORE = rf"[{RUN_START}][{RUN_START}()/\-{SPACE}]{{3,}}+"
RUN_TYPES = [
    "PHONE", "CREDIT_CARD", "IBAN", "PERSONAL_ID", "SOCIAL_SECURITY", "TAX_ID", "VAT_ID", "KVNR", "LICENSE_PLATE", "DRIVER_LICENSE",
]

# What stands behind a core and, read backwards, in front of it; each with one character more, which look-arounds may see.
ONE_MORE = r"(?s:.)?"
_LETTER = rf"[\p{{Alpha}}ÄÖÜäöü{FOLDED}ßẞ]"
_NAME = rf"[\p{{Alpha}}ÄÖÜäöü{FOLDED}ßẞ\-]*+"
_BETWEEN = rf"[\-{SPACE}]*+"
NEAR_CORE = {
    # the characters of addresses before and behind the @
    "EMAIL": ("@", rf"^[\w.%+\-{FOLDED}]*+{ONE_MORE}", rf"^[\w.%+\-{FOLDED}]*+{ONE_MORE}"),
    # the gate is the core: behind it up to three words of a city; in front the rest of the house number, then street and preposition, which are
    # at most four runs of letters and hyphens
    "ADDRESS": (
        GATES["ADDRESS"],
        rf"^{_LETTER}*+(?:(?:[{SPACE}]++|-){_LETTER}++){{0,2}}+{ONE_MORE}",
        rf"^[0-9]*+(?:[{SPACE}]*+/[{SPACE}]*+{_LETTER}?+[{SPACE}]*+[0-9]++)?+[{SPACE}]*+\.?+"
        rf"{_NAME}{_BETWEEN}{_NAME}{_BETWEEN}{_NAME}{_BETWEEN}{_NAME}{ONE_MORE}",
    ),
}
