"""Span algebra on the candidates of one text: white-listing, overlaps, placeholders, masking.

Everything works inside the row, needs no shuffle and is legal on streams. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions.arrays import bind, empty_array, fold_collect
from redactlake.functions.detectors import CANDIDATE

FINDING = (
    "struct<pii_type:string,start:bigint,end:bigint,text:string,confidence:double,placeholder:string,rule_id:string>"
)
PLACEHOLDER_PATTERN = r"\[(" + "|".join(fv.PII_TYPES) + r")_([0-9]+)\]"


def trimmed(token: Column) -> Column:
    return F.btrim(token, F.lit(fv.UNICODE_SPACES))


def merge_whitelists(default: Column, requested: Column) -> Column:
    """Default tokens, then requested ones: trimmed, blanks dropped, the first spelling of a token wins. Sorting brings the
    spellings of a token together."""
    both = F.concat(
        F.coalesce(default, empty_array("string")), F.coalesce(requested, empty_array("string"))
    )
    tokens = F.filter(F.transform(both, trimmed), lambda t: t.isNotNull() & (t != ""))
    keyed = F.sort_array(
        F.transform(tokens, lambda t, i: F.struct(F.lower(t).alias("key"), i.alias("place"), t.alias("token")))
    )

    def first_spellings(listed: Column) -> Column:
        firsts = F.filter(listed, lambda t, i: (i == 0) | (listed[i - 1]["key"] != t["key"]))
        placed = F.transform(firsts, lambda t: F.struct(t["place"].alias("place"), t["token"].alias("token")))
        return F.transform(F.sort_array(placed), lambda t: t["token"])

    return bind(keyed, first_spellings)


def clean_tokens(whitelist: Column) -> Column:
    """Tokens as they are looked for: trimmed, in lower case, without blank ones."""
    return F.filter(
        F.transform(F.coalesce(whitelist, empty_array("string")), lambda t: trimmed(F.lower(t))),
        lambda t: t.isNotNull() & (t != ""),
    )


def drop_whitelisted(candidates: Column, whitelist: Column, cleaned: bool = False) -> Column:
    """Remove candidates whose text contains a token of the list, ignoring case. ``cleaned``: the tokens are already in the
    form of ``clean_tokens``."""

    def remaining(listed: Column) -> Column:
        return F.filter(
            candidates,
            lambda c: ~bind(F.lower(c["text"]), lambda low: F.exists(listed, lambda t: F.contains(low, t))),
        )

    return bind(whitelist if cleaned else clean_tokens(whitelist), remaining)


def resolve_overlaps(candidates: Column) -> Column:
    """Non-overlapping candidates by start.

    Candidates are taken by start, then higher priority, then greater length, then position in the input. One that
    overlaps the last kept candidate replaces it if its priority is higher, or equal and it is longer.
    """
    nothing = F.lit(None).cast(CANDIDATE)

    def step(acc: Column, k: Column):
        last, this = acc["last"], k["candidate"]
        apart = last.isNull() | (this["start"] >= last["end"])
        wins = (this["prio"] > last["prio"]) | (
            (this["prio"] == last["prio"]) & (this["end"] - this["start"] > last["end"] - last["start"])
        )
        following = F.when(apart | wins, this).otherwise(last)
        return {"last": following}, F.when(apart, last)

    def finish(kept: Column, acc: Column) -> Column:
        return F.concat(kept, F.array(acc["last"]))

    def settled(found: Column) -> Column:
        keyed = F.sort_array(
            F.transform(
                found,
                lambda c, i: F.struct(
                    c["start"].alias("start"),
                    (-c["prio"]).alias("by_prio"),
                    (c["start"] - c["end"]).alias("by_length"),
                    i.alias("place"),
                    c.alias("candidate"),
                ),
            )
        )
        return F.when(
            F.size(found) > 1, fold_collect(keyed, {"last": nothing}, step, CANDIDATE, finish)
        ).otherwise(found)

    return bind(candidates, settled)


def assign_placeholders(resolved: Column) -> Column:
    """Number the distinct texts per type by first occurrence; an equal text shares its placeholder across types.

    Two sorts bring equal texts, then equal types together, so the cost is that of sorting.
    """

    def label(n: Column, pii_type: Column) -> Column:
        return F.concat(F.lit("["), pii_type, F.lit("_"), n.cast("string"), F.lit("]"))

    def placed(c: Column, placeholder: Column) -> Column:
        return F.struct(
            c["pii_type"].alias("pii_type"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["text"].alias("text"),
            c["confidence"].alias("confidence"),
            placeholder.alias("placeholder"),
            c["rule_id"].alias("rule_id"),
        )

    def many(found: Column) -> Column:
        by_text = F.sort_array(
            F.transform(
                found, lambda c, i: F.struct(c["text"].alias("text"), i.alias("i"), c["pii_type"].alias("pii_type"))
            )
        )

        def name_first(acc: Column, t: Column):
            new = acc["text"].isNull() | (acc["text"] != t["text"])
            first = F.when(new, t["i"]).otherwise(acc["first"])
            kind = F.when(new, t["pii_type"]).otherwise(acc["kind"])
            owner = F.struct(kind.alias("kind"), first.alias("first"), t["i"].alias("i"))
            return {"text": t["text"], "first": first, "kind": kind}, owner

        nothing = F.lit(None).cast("string")
        owners = fold_collect(
            by_text,
            {"text": nothing, "first": F.lit(None).cast("int"), "kind": nothing},
            name_first,
            "struct<kind:string,first:int,i:int>",
        )

        def count(acc: Column, o: Column):
            same_kind = F.coalesce(acc["kind"] == o["kind"], F.lit(False))
            same_text = same_kind & (acc["first"] == o["first"])
            n = F.when(same_text, acc["n"]).when(same_kind, acc["n"] + 1).otherwise(1)
            numbered = F.struct(o["i"].alias("i"), label(n, o["kind"]).alias("placeholder"))
            return {"kind": o["kind"], "first": o["first"], "n": n}, numbered

        numbered = F.sort_array(
            fold_collect(
                F.sort_array(owners),
                {"kind": nothing, "first": F.lit(None).cast("int"), "n": F.lit(0)},
                count,
                "struct<i:int,placeholder:string>",
            )
        )
        return bind(numbered, lambda ns: F.transform(found, lambda c, i: placed(c, ns[i]["placeholder"])))

    def alone(found: Column) -> Column:
        return F.transform(found, lambda c: placed(c, label(F.lit(1), c["pii_type"])))

    return bind(resolved, lambda found: F.when(F.size(found) > 1, many(found)).otherwise(alone(found)))


def mask(text: Column, findings: Column) -> Column:
    """Text with every finding replaced by its placeholder: gaps and placeholders, joined from left to right.

    ``findings`` is bound, since a filter on the result makes Spark put the expression behind it in its place.
    """

    def spliced(raw: Column, found: Column) -> Column:
        def part(f: Column, i: Column) -> Column:
            gap_start = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(found[i - 1]["end"])
            gap = F.substring(raw, (gap_start + 1).cast("int"), (f["start"] - gap_start).cast("int"))
            return F.concat(gap.cast("string"), f["placeholder"])

        last_end = found[F.size(found) - 1]["end"]
        tail = F.substring(raw, (last_end + 1).cast("int"), F.octet_length(raw))
        return F.array_join(F.concat(F.transform(found, part), F.array(tail.cast("string"))), "")

    return bind(
        findings,
        lambda found: F.when(
            F.size(found) > 0, bind(text.cast("binary"), lambda raw: spliced(raw, found))
        ).otherwise(text),
    )


def mapping_of(findings: Column) -> Column:
    """Array of distinct (placeholder, text) pairs."""
    return F.array_distinct(
        F.transform(
            findings, lambda f: F.struct(f["placeholder"].alias("placeholder"), f["text"].alias("text"))
        )
    )
