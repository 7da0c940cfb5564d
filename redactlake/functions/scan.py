"""The whole scan of one text as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions.arrays import bind, built_once, empty_array
from redactlake.functions.detectors import candidates_of
from redactlake.functions.spans import (
    FINDING,
    assign_placeholders,
    drop_whitelisted,
    mask,
    resolve_overlaps,
)


@dataclass(frozen=True)
class ScanOptions:
    """What to look for.

    ``detectors`` and ``whitelist`` are either fixed lists or the name of an array column with one list per row. An
    empty or missing detector list means all detectors; unknown names match nothing; names are compared in upper case,
    not trimmed.
    """

    detectors: tuple[str, ...] | str | None = None
    whitelist: tuple[str, ...] | str | None = None

    def __post_init__(self):
        for name in ("detectors", "whitelist"):
            value = getattr(self, name)
            if value is not None and not isinstance(value, str):
                object.__setattr__(self, name, tuple(value))


def findings_of(text: Column, options: ScanOptions = ScanOptions()) -> Column:
    """Findings of a text by start, with placeholders."""
    detectors, whitelist = options.detectors, options.whitelist
    fixed = not isinstance(whitelist, str)
    if isinstance(detectors, str):
        detectors = F.col(detectors)
    if not fixed:
        tokens = F.col(whitelist)
    else:
        cleaned = [t.lower().strip(fv.UNICODE_SPACES) for t in whitelist or ()]
        tokens = F.array(*[F.lit(t) for t in cleaned if t]) if any(cleaned) else None

    def settle(candidates: Column) -> Column:
        kept = candidates if tokens is None else drop_whitelisted(candidates, tokens, cleaned=fixed)
        return F.when(
            F.size(candidates) > 0, bind(kept, lambda k: assign_placeholders(resolve_overlaps(k)))
        ).otherwise(empty_array(FINDING))

    return bind(candidates_of(text, detectors), settle)


@built_once
def column_candidates(text: str, detectors: tuple[str, ...] | None = None) -> Column:
    """``candidates_of`` for a column name and a fixed list of detectors."""
    return candidates_of(F.col(text), detectors)


@built_once
def column_findings(text: str, options: ScanOptions = ScanOptions()) -> Column:
    """``findings_of`` for a column name."""
    return findings_of(F.col(text), options)


def masked_text(text: Column, options: ScanOptions = ScanOptions()) -> Column:
    return bind(findings_of(text, options), lambda f: mask(text, f))


def scan_struct(text: Column, options: ScanOptions = ScanOptions()) -> Column:
    """Masked text and findings as one struct, for use inside arrays of texts."""
    return bind(
        findings_of(text, options),
        lambda f: F.struct(mask(text, f).alias("anonymised_text"), f.alias("findings")),
    )
