"""Request bodies: telling JSON objects from raw text, and finding the texts to mask inside."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from redactlake.functions.arrays import bind, built_once, empty_array
from redactlake.functions.json_text import count_keys, key_step, quoted, replace_strings
from redactlake.functions.scan import ScanOptions, scan_struct

SEGMENT = "struct<path:string,text:string>"
_NODE = "struct<path:string,value:variant>"
_FIELDS = "map<string,variant>"


REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def allow_repeated_keys(spark: SparkSession) -> None:
    """JSON objects may repeat a key; the last one counts. Spark reads this from the session when it plans a query."""
    spark.conf.set(REPEATED_KEYS, "true")


def _proven(body: Column) -> tuple[Column, Column]:
    """The body as first element of an array that ends in the body's own hash, and the hash.

    A parser stops after the first value of a text; only if nothing else follows the body's value, the hash is in second
    place.
    """
    proof = F.md5(body)
    return F.concat(F.lit("["), body, F.lit(',"'), proof, F.lit('"]')), proof


def json_document(body: Column) -> Column:
    """The body as one JSON value, NULL if it is none."""
    wrapped, proof = _proven(body)
    return bind(
        F.try_parse_json(wrapped),
        lambda w: F.when(F.try_variant_get(w, "$[1]", "string") == proof, F.try_variant_get(w, "$[0]", "variant")),
    )


def body_kind(body: Column, document: Column) -> Column:
    """empty, json (an object, or null), text (anything else, valid JSON or not) or reject (an object in valid JSON that the
    parser refuses for its size or depth). ``document``: the body's ``json_document``."""
    start = F.ltrim(body, F.lit(" \t\r\n"))
    objects = F.startswith(start, F.lit("{")) | F.startswith(start, F.lit("null"))
    wrapped, proof = _proven(body)
    refused = objects & document.isNull() & (F.get_json_object(wrapped, "$[1]") == proof)
    return (
        F.when(body.isNull() | (F.octet_length(body) == 0), "empty")
        .when(objects & document.isNotNull(), "json")
        .when(refused, "reject")
        .otherwise("text")
    )


def triage_kind(body: Column, document: Column, dry_run: Column) -> Column:
    """As ``body_kind``, with dry_run for every body that is not empty where a dry run is asked for."""
    return bind(body_kind(body, document), lambda k: F.when(dry_run & (k != "empty"), "dry_run").otherwise(k))


def _string(value: Column, path: str) -> Column:
    """The string at a path, NULL for other JSON types."""
    return bind(
        F.try_variant_get(value, path, "variant"),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )


def _array(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _segment(path: Column, text: Column) -> Column:
    return F.array(F.struct(path.alias("path"), text.alias("text"))).cast(f"array<{SEGMENT}>")


def _string_segments(path: Column, text: Column) -> Column:
    return F.when(text.isNotNull(), _segment(path, text)).otherwise(empty_array(SEGMENT))


def _strings_in_objects(path: Column, value: Column) -> Column:
    """All strings of an object and of objects in it, at any depth; arrays are not entered.

    Works level by level. The schema of the value names every object once, so their number is a bound for the depth
    that comes from the data; levels below the last one find nothing left to do.
    """
    schema = F.schema_of_variant(value)
    levels = (F.length(schema) - F.length(F.replace(schema, F.lit("OBJECT<"), F.lit("")))) / 7

    def children(node: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(node["value"], "$", _FIELDS))
        return F.transform(
            fields,
            lambda e: F.struct(F.concat(node["path"], key_step(e["key"])).alias("path"), e["value"].alias("value")),
        )

    def descend(acc: Column, _: Column) -> Column:
        level = F.flatten(F.transform(acc["objects"], children))

        def split(nodes: Column) -> Column:
            texts = F.transform(
                nodes, lambda n: F.struct(n["path"].alias("path"), _string(n["value"], "$").alias("text"))
            )
            return F.struct(
                F.filter(nodes, lambda n: F.try_variant_get(n["value"], "$", _FIELDS).isNotNull()).alias("objects"),
                F.concat(acc["found"], F.filter(texts, lambda t: t["text"].isNotNull())).alias("found"),
            )

        return F.when(F.size(acc["objects"]) > 0, bind(level, split)).otherwise(acc)

    root = F.array(F.struct(path.alias("path"), value.alias("value"))).cast(f"array<{_NODE}>")
    return F.when(
        F.try_variant_get(value, "$", _FIELDS).isNotNull(),
        F.aggregate(
            F.sequence(F.lit(1), levels.cast("int")),
            F.struct(root.alias("objects"), empty_array(SEGMENT).alias("found")),
            descend,
            lambda acc: acc["found"],
        ),
    ).otherwise(empty_array(SEGMENT))


def _block_segments(path: Column, block: Column) -> Column:
    kind = F.try_variant_get(block, "$.type", "string")
    result = F.concat(path, F.lit(".content"))
    parts = F.flatten(
        F.transform(
            _array(block, "$.content"),
            lambda part, i: _string_segments(F.concat(result, _place(i), F.lit(".text")), _string(part, "$.text")),
        )
    )
    return (
        F.when(kind == "text", _string_segments(F.concat(path, F.lit(".text")), _string(block, "$.text")))
        .when(kind == "tool_result", F.concat(_string_segments(result, _string(block, "$.content")), parts))
        .when(
            kind == "tool_use",
            bind(
                F.try_variant_get(block, "$.input", "variant"),
                lambda v: _strings_in_objects(F.concat(path, F.lit(".input")), v),
            ),
        )
        .otherwise(empty_array(SEGMENT))
    )


def _place(i: Column) -> Column:
    return F.concat(F.lit("["), i.cast("string"), F.lit("]"))


def message_segments(document: Column) -> Column:
    """Texts of the user messages of a body: plain content, text blocks, tool results and tool inputs."""

    def of_message(message: Column, i: Column) -> Column:
        path = F.concat(F.lit("messages"), _place(i), F.lit(".content"))
        blocks = F.flatten(
            F.transform(
                _array(message, "$.content"), lambda block, j: _block_segments(F.concat(path, _place(j)), block)
            )
        )
        return F.when(
            F.try_variant_get(message, "$.role", "string") == "user",
            F.concat(_string_segments(path, _string(message, "$.content")), blocks),
        ).otherwise(empty_array(SEGMENT))

    return F.flatten(F.transform(_array(document, "$.messages"), of_message))


def whole_body(body: Column) -> Column:
    return _segment(F.lit("body"), body)


@built_once
def segments_of(body: str, kind: str, document: str) -> Column:
    """Texts to scan, by column names: those of user messages, or the whole body of raw text and dry runs."""
    return (
        F.when(F.col(kind) == "json", message_segments(F.col(document)))
        .when(F.col(kind).isin("text", "dry_run"), whole_body(F.col(body)))
        .otherwise(empty_array(SEGMENT))
    )


@built_once
def scan_segments(segments: str, options: ScanOptions = ScanOptions()) -> Column:
    """Scan every text of an array column of segments on its own; placeholders start anew in each."""

    def scanned(segment: Column) -> Column:
        return bind(
            scan_struct(segment["text"], options),
            lambda s: F.struct(
                segment["path"].alias("path"),
                segment["text"].alias("text"),
                s["anonymised_text"].alias("anonymised_text"),
                s["findings"].alias("findings"),
            ),
        )

    return F.transform(segments, scanned)


def rewritten_body(body: Column, kind: Column, document: Column, texts: Column) -> Column:
    """The body with texts put in place: ``texts`` holds (path, text) of the strings that change.

    Of a JSON body nothing else changes, unless it repeats a key: then the values that don't count, which nobody has scanned, must
    not go on, and the body is written anew from its parsed value. Raw text is replaced whole. A body of kind reject, which can't be
    scanned, is NULL; empty ones and dry runs stay as they are.
    """
    once = F.to_json(document)
    base = F.when(count_keys(body) > count_keys(once), once).otherwise(body)
    by_path = F.map_from_entries(F.transform(texts, lambda t: F.struct(t["path"].alias("path"), quoted(t["text"]).alias("text"))))
    json = bind(base, lambda b: F.when(F.size(texts) > 0, bind(by_path, lambda m: replace_strings(b, m))).otherwise(b))
    return (
        F.when(kind == "json", json)
        .when(kind == "text", F.coalesce(F.get(texts, F.lit(0))["text"], body))
        .when(kind.isin("empty", "dry_run"), body)
    )
