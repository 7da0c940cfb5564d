"""Undoing the masking with the vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions.arrays import bind
from redactlake.functions.bodies import allow_repeated_keys, json_document, message_segments, rewritten_body, whole_body
from redactlake.functions.spans import PLACEHOLDER_PATTERN

# a placeholder without its opening bracket, where a text is cut at brackets
_OPENED = "^(?:{0})_[0-9]+\\]".format("|".join(fv.PII_TYPES))


def _original(placeholder: Column, vault: Column) -> Column:
    """The text behind a placeholder. A complete vault of a type holds number n in place n, so that the look-up is direct; if
    entries are missing, the type's list is searched for the number."""
    entries = vault[F.regexp_extract(placeholder, PLACEHOLDER_PATTERN, 1)]
    number = F.regexp_extract(placeholder, PLACEHOLDER_PATTERN, 2).try_cast("int")
    direct = F.get(entries, number - 1)
    searched = F.get(F.filter(entries, lambda e: e["n"] == number), F.lit(0))
    return F.coalesce(F.when(direct["n"] == number, direct["text"]).otherwise(searched["text"]), placeholder)


def _by_type(entries: Column) -> Column:
    """Sorted distinct (type, n, text) as a map from type to its (n, text) by n; of two texts with one number the first."""
    single = F.filter(
        entries,
        lambda e, i: (i == 0) | (entries[i - 1]["type"] != e["type"]) | (entries[i - 1]["n"] != e["n"]),
    )
    types = F.array_distinct(F.transform(entries, lambda e: e["type"]))
    return F.map_from_arrays(types, F.transform(types, lambda t: F.filter(single, lambda e: e["type"] == t)))


def _vaults(mapping: DataFrame, *keys: str) -> DataFrame:
    """One vault per scan (or request and path), as a map from type to texts by number."""
    entry = F.struct(
        F.regexp_extract("placeholder", PLACEHOLDER_PATTERN, 1).alias("type"),
        F.regexp_extract("placeholder", PLACEHOLDER_PATTERN, 2).try_cast("int").alias("n"),
        F.col("text").alias("text"),
    )
    known = mapping.where(F.col("placeholder").rlike(PLACEHOLDER_PATTERN))
    vaults = known.groupBy(*keys).agg(F.sort_array(F.collect_set(entry)).alias("_entries"))
    return vaults.select(*keys, _by_type(F.col("_entries")).alias("_vault"))


def _restored(text: Column, vault: Column) -> Column:
    """Cut at opening brackets, which is a search for one character; whether a placeholder follows is then seen right behind each."""

    def put_back(piece: Column, opened: Column) -> Column:
        behind = F.substr(piece, F.length(opened) + 1)
        original = _original(F.concat(F.lit("["), opened), vault)
        return F.when(opened != "", F.concat(original, behind)).otherwise(F.concat(F.lit("["), piece))

    pieces = F.transform(
        F.split(text, r"\[", -1),
        lambda p, i: F.when(i == 0, p).otherwise(bind(F.regexp_extract(p, _OPENED, 0), lambda opened: put_back(p, opened))),
    )
    return F.array_join(pieces, "")


def restore(redacted: DataFrame, mapping: DataFrame, key: str = "scan_id") -> DataFrame:
    """Put the texts back: key, restored_text. Placeholders that the vault does not know stay.

    The vault may lack entries, repeat them and come in any order. Only texts that hold a placeholder are joined; all
    others go through without a shuffle. A scan's vault is as large as its findings at most.
    """
    holds = F.col("anonymised_text").rlike(PLACEHOLDER_PATTERN)
    vaults = _vaults(mapping, key)
    text = F.col("anonymised_text")
    joined = redacted.where(holds).join(vaults, key, "left")
    restored = joined.select(key, _restored(text, F.col("_vault")).alias("restored_text"))
    untouched = redacted.where(~F.coalesce(holds, F.lit(False))).select(key, text.alias("restored_text"))
    return restored.unionByName(untouched)


def restore_bodies(masked: DataFrame, vault: DataFrame, key: str = "request_id") -> DataFrame:
    """Undo the masking of bodies: key, restored_body of ``masked`` (key, masked_body) by ``vault`` (key, path, placeholder, text).

    A placeholder is looked up under its request and path only. A body whose vault has the path ``body`` was raw text and is restored
    as such, whatever its masked form looks like. Only bodies that hold a placeholder are joined. Strings that held no placeholder stay as
    they stand; restored ones are written as JSON anew, so that an unusual escape in them may come back as another one.
    """
    allow_repeated_keys(masked.sparkSession)
    body = F.col("masked_body")
    by_path = _vaults(vault, key, "path").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("path", "_vault"))).alias("_paths")
    )
    holds = body.rlike(PLACEHOLDER_PATTERN)
    joined = masked.select(key, "masked_body").where(holds).join(by_path, key, "left")
    known = joined.where(F.col("_paths").isNotNull()).withColumn("_document", json_document(body))
    raw = F.map_contains_key("_paths", F.lit("body"))
    kind = F.when(raw | F.col("_document").isNull(), "text").otherwise("json")
    segments = F.when(kind == "text", whole_body(body)).otherwise(message_segments(F.col("_document")))
    texts = F.transform(
        F.filter("_segments", lambda s: F.map_contains_key("_paths", s["path"])),
        lambda s: F.struct(
            s["path"].alias("path"), _restored(s["text"], F.try_element_at("_paths", s["path"])).alias("text")
        ),
    )
    restored = (
        known.withColumn("_kind", kind)
        .withColumn("_segments", segments)
        .withColumn("_texts", texts)
        .select(key, rewritten_body(body, F.col("_kind"), F.col("_document"), F.col("_texts")).alias("restored_body"))
    )
    strange = joined.where(F.col("_paths").isNull()).select(key, body.alias("restored_body"))
    untouched = masked.where(~F.coalesce(holds, F.lit(False))).select(key, body.alias("restored_body"))
    return restored.unionByName(strange).unionByName(untouched)
