"""Detectors: what each type looks for and which matches it keeps.

A detector finds all matches first and filters them afterwards: a rejected match still uses up its text. Confidence
is information only; it never decides whether something is masked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions import checksums as ck
from redactlake.functions.arrays import bind, empty_array
from redactlake.functions.hits import Search, hits_of_all, shortened
from redactlake.functions.patterns import GATES, NEAR_CORE, PATTERNS, RUN_CORE, RUN_TYPES, SHARED_GATE_OF, SHARED_GATES, to_java

CANDIDATE = (
    "struct<pii_type:string,start:bigint,end:bigint,text:string,confidence:double,rule_id:string,prio:int,ordinal:int>"
)


@dataclass(frozen=True)
class Rule:
    """One pattern of a detector. ``keep`` turns its hits (and the text) into an array of candidates."""

    pii_type: str
    pattern: str
    gate: Callable[[Column], Column]
    keep: Callable[[Column, Column], Column]


def _candidate(pii_type: str, hit: Column, confidence, rule_id: str | None = None, text=None, start=None, end=None):
    score = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        F.lit(pii_type).alias("pii_type"),
        (hit["start"] if start is None else start).alias("start"),
        (hit["end"] if end is None else end).alias("end"),
        (hit["text"] if text is None else text).alias("text"),
        score.cast("double").alias("confidence"),
        F.lit(rule_id).cast("string").alias("rule_id"),
        F.lit(fv.PRIORITY[pii_type]).alias("prio"),
        F.lit(fv.PII_TYPES.index(pii_type)).alias("ordinal"),
    )


def _fits(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def _holds(*literals: str) -> Callable[[Column], Column]:
    """Compares bytes, unlike patterns, for which the text has to be decoded first. A sign that several literals have in common is looked for
    before them."""
    common = [c for c in literals[0] if not c.isalnum() and all(c in x for x in literals)] if len(literals) > 1 else []

    def gate(text: Column) -> Column:
        one = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals])
        return F.contains(text, F.lit(common[0])) & one if common else one

    return gate


def _every_match(pii_type: str, confidence, rule_id: str | None = None):
    """Keep all hits; ``confidence`` may look at the matched text."""

    def keep(found: Column, _: Column) -> Column:
        def one(h: Column) -> Column:
            return _candidate(pii_type, h, confidence(h["text"]) if callable(confidence) else confidence, rule_id)

        return F.transform(found, one)

    return keep


def _scored(keep):
    """Drop candidates that got no confidence."""
    return lambda found, text: F.filter(keep(found, text), lambda c: c["confidence"].isNotNull())


def _phone(found: Column, _: Column) -> Column:
    kept = F.filter(
        found,
        lambda h: ~h["before"].rlike("[0-9+]")
        & ~h["after"].rlike("[0-9]")
        & (F.length(ck.digits_of(h["text"])) >= 9),
    )
    return F.transform(kept, lambda h: _candidate("PHONE", h, 1.0))


def _credit_card(found: Column, _: Column) -> Column:
    alone = F.filter(found, lambda h: ~h["before"].rlike("[0-9]") & ~h["after"].rlike("[0-9]"))

    def scored(h: Column) -> Column:
        grouped = h["text"].rlike("[ -]")
        valid = ck.luhn_ok(ck.digits_of(h["text"]))
        # a bare number that fails the check is no card
        return _candidate("CREDIT_CARD", h, F.when(valid, F.when(grouped, 1.0).otherwise(0.9)).when(grouped, 0.6))

    return F.transform(alone, scored)


def _iban(found: Column, _: Column) -> Column:
    lengths = F.create_map(*[F.lit(v) for pair in fv.IBAN_LENGTHS.items() for v in pair])
    coded = F.transform(
        found,
        lambda h: F.struct(
            h["start"].alias("start"),
            F.rtrim(h["text"]).alias("text"),
            F.replace(h["text"], F.lit(" "), F.lit("")).alias("code"),
        ),
    )
    fitting = F.filter(
        coded, lambda h: F.coalesce(lengths[F.substring(h["code"], 1, 2)] == F.length(h["code"]), F.lit(False))
    )
    return F.transform(
        fitting,
        lambda h: _candidate(
            "IBAN",
            h,
            F.when(ck.iban_ok(h["code"]), 1.0).otherwise(0.6),
            end=h["start"] + F.octet_length(h["text"]),
        ),
    )


def _tax_id_score(raw: Column) -> Column:
    def against(digits: Column) -> Column:
        return bind(
            ck.tax_id_check(digits),
            lambda due: F.when(due == F.substring(digits, 11, 1).cast("int"), 1.0).when(due.isNotNull(), 0.6),
        )

    return bind(F.replace(raw, F.lit(" "), F.lit("")), against)


def _plate(confidence: float):
    """District, letters and number without a trailing E or H make up 4 to 8 characters."""
    every = _every_match("LICENSE_PLATE", confidence)
    return lambda found, text: F.filter(
        every(found, text), lambda c: F.length(F.regexp_replace(c["text"], "[- ]|[EH]$", "")).between(4, 8)
    )


def _driver_license(found: Column, text: Column) -> Column:
    """Only with a context word in the bytes around the match."""
    reach = fv.DRIVER_CONTEXT_BYTES

    def with_context(raw: Column) -> Column:
        def near(h: Column) -> Column:
            begin = F.greatest(F.lit(0).cast("bigint"), h["start"] - reach)
            window = F.substring(raw, (begin + 1).cast("int"), (h["end"] + reach - begin).cast("int"))
            return window.cast("string").rlike(PATTERNS["DRIVER_CONTEXT"])

        return F.filter(found, near)

    kept = F.when(F.size(found) > 0, bind(text.cast("binary"), with_context)).otherwise(found)
    return F.transform(kept, lambda h: _candidate("DRIVER_LICENSE", h, 0.75))


def _tail_of_match(pii_type: str, confidence: float, value: Callable[[Column], Column], rule_id: str | None = None):
    """The finding is the last part of the match only."""

    def one(h: Column) -> Column:
        return bind(
            value(h["text"]),
            lambda v: _candidate(pii_type, h, confidence, rule_id, text=v, start=h["end"] - F.octet_length(v)),
        )

    return lambda found, _: F.transform(found, one)


def _secret_rules() -> Iterable[Rule]:
    for rule_id, pattern, literals, confidence in fv.SECRET_RULES:
        java = PATTERNS.get(rule_id) or to_java(pattern)
        yield Rule("SECRET", java, _holds(*literals), _every_match("SECRET", confidence, rule_id))
    yield Rule(
        "SECRET",
        PATTERNS["GENERIC_SECRET"],
        _fits(GATES["GENERIC_SECRET"]),
        _tail_of_match(
            "SECRET",
            fv.GENERIC_SECRET_CONFIDENCE,
            lambda m: F.regexp_extract(m, PATTERNS["GENERIC_SECRET_VALUE"], 1),
            fv.GENERIC_SECRET_RULE,
        ),
    )


def _after_equals(match: Column) -> Column:
    return F.substr(match, F.instr(match, "=") + 1)


# in registration order; a detector may have several rules
RULES: list[Rule] = [
    *_secret_rules(),
    Rule(
        "URL_SECRET",
        PATTERNS["URL_SECRET"],
        lambda text: _holds("=")(text) & _holds("?", "&")(text) & _fits(GATES["URL_SECRET"])(text),
        _tail_of_match("URL_SECRET", fv.URL_SECRET_CONFIDENCE, _after_equals),
    ),
    Rule("EMAIL", PATTERNS["EMAIL"], _holds("@"), _every_match("EMAIL", 1.0)),
    Rule("PHONE", PATTERNS["PHONE"], _fits(GATES["PHONE"]), _phone),
    Rule("CREDIT_CARD", PATTERNS["CREDIT_CARD"], _fits(GATES["CREDIT_CARD"]), _scored(_credit_card)),
    Rule("IBAN", PATTERNS["IBAN"], _fits(GATES["IBAN"]), _iban),
    Rule("PERSONAL_ID", PATTERNS["PERSONAL_ID"], _fits(GATES["PERSONAL_ID"]), _every_match("PERSONAL_ID", 0.75)),
    Rule(
        "SOCIAL_SECURITY",
        PATTERNS["SOCIAL_SECURITY"],
        _fits(GATES["SOCIAL_SECURITY"]),
        _every_match("SOCIAL_SECURITY", 0.9),
    ),
    Rule("TAX_ID", PATTERNS["TAX_ID"], _fits(GATES["TAX_ID"]), _scored(_every_match("TAX_ID", _tax_id_score))),
    Rule(
        "VAT_ID",
        PATTERNS["VAT_ID"],
        lambda text: _holds("DE")(text) & _fits(GATES["VAT_ID"])(text),
        _every_match("VAT_ID", 0.85),
    ),
    Rule(
        "KVNR",
        PATTERNS["KVNR"],
        _fits(GATES["KVNR"]),
        _every_match("KVNR", lambda raw: F.when(ck.kvnr_ok(raw), 0.95).otherwise(0.6)),
    ),
    Rule("LICENSE_PLATE", PATTERNS["PLATE_HYPHEN"], _fits(GATES["PLATE_HYPHEN"]), _plate(0.75)),
    Rule("LICENSE_PLATE", PATTERNS["PLATE_SPACE"], _fits(GATES["PLATE_SPACE"]), _plate(0.65)),
    Rule("DRIVER_LICENSE", PATTERNS["DRIVER_LICENSE"], _fits(GATES["DRIVER_LICENSE"]), _driver_license),
    Rule("ADDRESS", PATTERNS["ADDRESS"], _fits(GATES["ADDRESS"]), _every_match("ADDRESS", 0.9)),
]


def select_detectors(names: Iterable[str]) -> list[str]:
    """Types to run: names are compared in upper case, not trimmed; none means all, unknown ones match nothing."""
    wanted = [n.upper() for n in names]
    return [t for t in fv.PII_TYPES if t in wanted] if wanted else list(fv.PII_TYPES)


def _runs(text: Column) -> Column:
    """The text cut down to the runs that hold all matches of RUN_TYPES."""
    return shortened(text, RUN_CORE, lambda gap: F.left(gap, F.lit(1)), lambda gap: F.right(gap, F.lit(1)))


def _near_core(text: Column, pii_type: str) -> Column:
    """The text cut down to what lies near the cores of a type."""
    core, behind, in_front = NEAR_CORE[pii_type]

    def tail(gap: Column) -> Column:
        return F.reverse(F.regexp_extract(F.reverse(gap), in_front, 0))

    return shortened(text, core, lambda gap: F.regexp_extract(gap, behind, 0), tail)


def candidates_of(text: Column, detectors: Iterable[str] | Column | None = None) -> Column:
    """All candidates of the selected detectors in registration order, before white list and overlaps.

    With a fixed list, other detectors do not get into the plan; with one list per row they are gated by it.
    """
    per_row = isinstance(detectors, Column)
    chosen = fv.PII_TYPES if per_row else select_detectors(detectors or [])
    rules = [r for r in RULES if r.pii_type in chosen]
    if not rules:
        return empty_array(CANDIDATE)
    sharing = Counter(SHARED_GATE_OF.get(r.pii_type) for r in rules)
    # one pass that cuts the text down to runs pays off from three searches on
    in_runs = sum(r.pii_type in RUN_TYPES for r in rules) > 2

    def searches(shared: Column) -> list[Search]:
        out = []
        for r in rules:
            short = in_runs and r.pii_type in RUN_TYPES
            where = shared["runs"] if short else text
            gate, group = r.gate(where), SHARED_GATE_OF.get(r.pii_type)
            if group and sharing[group] > 1:
                gate = shared[group] & gate
            if per_row:
                gate = (shared["all"] | F.array_contains(shared["wanted"], r.pii_type)) & gate
            if r.pii_type in NEAR_CORE:
                short, where = True, _near_core(text, r.pii_type)
            out.append(Search(where, r.pattern, gate, short))
        return out

    def kept(found: Column) -> Column:
        parts = [F.when(F.size(found[i]) > 0, r.keep(found[i], text)).otherwise(empty_array(CANDIDATE)) for i, r in enumerate(rules)]
        return F.when(F.exists(found, lambda h: F.size(h) > 0), F.flatten(F.array(*parts))).otherwise(empty_array(CANDIDATE))

    def conditions_in(runs: Column) -> list[Column]:
        return [runs.rlike(p).alias(g) for g, p in SHARED_GATES.items() if sharing[g] > 1]

    conditions = [F.lit(True).alias("_")]
    if per_row:
        wanted = F.transform(F.coalesce(detectors, empty_array("string")), F.upper)
        conditions += [wanted.alias("wanted"), (F.size(wanted) == 0).alias("all")]
    runs = _runs(text) if in_runs else text
    gated = bind(runs, lambda r: F.struct(*conditions, r.alias("runs"), *conditions_in(r)))
    return bind(gated, lambda shared: bind(hits_of_all(searches(shared)), kept))
