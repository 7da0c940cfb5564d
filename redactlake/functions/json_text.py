"""Replacing strings inside JSON text by their path, with everything else left as it stands.

The text is cut into strings, signs and what is between them. A fold over these pieces keeps the open objects and arrays, so
that every string that is a value has its path; those with a replacement are exchanged, and the pieces are joined
again. The cost follows the number of pieces and, for each string, the number of replacements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.functions.arrays import bind, fold_collect

_PIECES = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^"{}\[\],:]++'
_PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_-]*\z"
_OPEN = "struct<path:string,is_object:boolean,place:int>"


def quoted(text: Column) -> Column:
    """A text as JSON string."""
    return bind(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.char_length(j) - 2))


def key_step(key: Column) -> Column:
    """What a key adds to a path: .key, or ["key"] as JSON where it isn't made of letters, digits, _ and - only, so that two
    places never have the same path."""
    return F.when(key.rlike(_PLAIN_KEY), F.concat(F.lit("."), key)).otherwise(F.to_json(F.array(key)))


def _decoded(piece: Column) -> Column:
    plain = F.substring(piece, F.lit(2), F.char_length(piece) - 2)
    return F.when(F.contains(piece, F.lit("\\")), F.try_variant_get(F.try_parse_json(piece), "$", "string")).otherwise(plain)


def pieces_of(json: Column) -> Column:
    """All pieces of a valid JSON text, in order."""
    return F.regexp_extract_all(json, F.lit(_PIECES), F.lit(0))


def count_keys(json: Column) -> Column:
    """How many keys the objects of a JSON text have, repeated ones included."""
    return F.size(F.filter(pieces_of(json), lambda p: p == ":"))


def replace_strings(json: Column, by_path: Column) -> Column:
    """A valid JSON text with the strings at the paths of a map (path to JSON string) replaced."""

    def step(acc: Column, piece: Column):
        depth = F.size(acc["stack"])
        top = F.get(acc["stack"], depth - 1)
        below = F.slice(acc["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
        here = (
            F.when(depth == 0, "")
            .when(top["is_object"], F.concat(top["path"], acc["key"]))
            .otherwise(F.concat(top["path"], F.lit("["), top["place"].cast("string"), F.lit("]")))
        )
        opened = F.struct(here.alias("path"), (piece == "{").alias("is_object"), F.lit(0).alias("place")).cast(_OPEN)
        following = F.struct(
            top["path"].alias("path"), top["is_object"].alias("is_object"), (top["place"] + 1).alias("place")
        ).cast(_OPEN)
        is_string = F.startswith(piece, F.lit('"'))
        is_key = is_string & acc["key_next"]
        state = {
            "stack": F.when(piece.isin("{", "["), F.concat(acc["stack"], F.array(opened)))
            .when(piece.isin("}", "]"), below)
            .when(piece == ",", F.concat(below, F.array(following)))
            .otherwise(acc["stack"]),
            "key": F.when(is_key, key_step(_decoded(piece))).otherwise(acc["key"]),
            "key_next": F.when(piece == "{", True)
            .when(piece == ",", top["is_object"])
            .when(piece.isin("[", "]", "}", ":") | is_string, False)
            .otherwise(acc["key_next"]),
        }
        replaced = F.when(is_string & ~acc["key_next"], F.try_element_at(by_path, F.ltrim(here, F.lit("."))))
        return state, F.coalesce(replaced, piece)

    start = {"stack": F.array().cast(f"array<{_OPEN}>"), "key": F.lit(""), "key_next": F.lit(False)}
    return fold_collect(pieces_of(json), start, step, "string", lambda done, _: F.array_join(done, ""))
