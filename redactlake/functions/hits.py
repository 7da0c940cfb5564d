"""All leftmost, non-overlapping matches of a pattern with byte offsets, as array columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.functions.arrays import bind, empty_array, fold_collect

# marks the two ends of a match; no pattern can match this character
MARK = "\x01"
STAND_IN = "\x02"
# stands on both sides of the length of what was left out; no match can hold this character either
CUT = "\x03"
# texts below this are searched whole: cutting them down would cost more
SHORT_BYTES = 500

HIT = "struct<start:bigint,end:bigint,text:string,before:string,after:string>"


def cut_at_matches(text: Column, pattern: str) -> Column:
    """Cut a text at both ends of each match: pieces at odd (0-based) places are the matches, the others what lies
    between. Texts that hold the mark themselves get another control character of the same length in its place."""
    markable = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    return F.split(F.regexp_replace(markable, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def shortened(text: Column, core: str, head: Callable[[Column], Column], tail: Callable[[Column], Column]) -> Column:
    """The text without what lies too far from the matches of ``core`` to have a part in a match of another pattern; NULL if there are none. Texts
    below SHORT_BYTES stay whole.

    Of each gap between two matches of ``core``, ``head`` gives the beginning that belongs to the one before and ``tail`` the end that belongs to the one
    behind it, each with one character more for look-arounds. The rest gives way to its length between two CUT, in at most eight hexadecimal digits, which
    are too few for a match; a gap in which both meet stays whole.
    """

    def ends(gap: Column, i: Column, last: Column) -> Column:
        nothing = F.lit("")
        return F.struct(
            F.when(i > 0, head(gap)).otherwise(nothing).alias("head"), F.when(i < last, tail(gap)).otherwise(nothing).alias("tail")
        )

    def without_middle(gap: Column, kept: Column) -> Column:
        between = F.octet_length(gap) - F.octet_length(kept["head"]) - F.octet_length(kept["tail"])
        short = F.concat(kept["head"], F.lit(CUT), F.hex(between), F.lit(CUT), kept["tail"])
        return F.when(between > 0, short).otherwise(gap)

    def joined(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        parts = F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, p).otherwise(bind(ends(p, i, last), lambda kept: without_middle(p, kept))),
        )
        return F.array_join(parts, "")

    cuttable = F.when(F.contains(text, F.lit(CUT)), F.translate(text, CUT, STAND_IN)).otherwise(text)
    cut = bind(cut_at_matches(cuttable, core), lambda pieces: F.when(F.size(pieces) > 1, joined(pieces)))
    return F.when(F.octet_length(text) < SHORT_BYTES, cuttable).otherwise(cut)


def _left_out(gap: Column) -> Column:
    """How many more bytes than its own a gap of a shortened text stands for."""

    def more(part: Column, i: Column) -> Column:
        number = F.conv(part, 16, 10).cast("bigint")
        return F.when(i % 2 == 1, number - F.octet_length(part) - 2).otherwise(0)

    each = F.transform(F.split(gap, CUT, -1), more)
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda total, n: total + n)


def hits_in(pieces: Column, short: Column) -> Column:
    """Matches with their byte offsets, the running lengths of the pieces, and the characters right before and after.
    ``short``: the pieces are those of a shortened text; offsets are those in the whole text."""

    def step(acc: Column, i: Column):
        gap, match, rest = pieces[2 * i - 2], pieces[2 * i - 1], pieces[2 * i]
        before = F.when(gap != "", F.right(gap, F.lit(1))).when(i > 1, F.right(pieces[2 * i - 3], F.lit(1)))
        after = F.when(rest != "", F.left(rest, F.lit(1))).when(
            2 * i + 1 < F.size(pieces), F.left(pieces[2 * i + 1], F.lit(1))
        )
        skipped = F.when(short & F.contains(gap, F.lit(CUT)), _left_out(gap)).otherwise(0)
        start = acc["at"] + F.octet_length(gap) + skipped
        end = start + F.octet_length(match)
        hit = F.struct(
            start.alias("start"),
            end.alias("end"),
            match.alias("text"),
            F.coalesce(before, F.lit("")).alias("before"),
            F.coalesce(after, F.lit("")).alias("after"),
        )
        return {"at": end}, hit

    begin = {"at": F.lit(0).cast("bigint")}
    places = F.sequence(F.lit(1), F.floor(F.size(pieces) / 2).cast("int"))
    # most searches find one match at most
    return (
        F.when(F.size(pieces) == 3, F.array(step(begin, F.lit(1))[1].cast(HIT)))
        .when(F.size(pieces) > 1, fold_collect(places, begin, step, HIT))
        .otherwise(empty_array(HIT))
    )


@dataclass(frozen=True)
class Search:
    """All matches of ``pattern`` in ``text``. ``gate``: a cheap condition that every text with a match meets; where it fails, the text is not
    searched. ``short``: the text is a shortened one."""

    text: Column
    pattern: str
    gate: Column
    short: bool = False


def hits_of_all(searches: list[Search]) -> Column:
    """For each search the array of its hits, in order."""

    def cut(search: Search) -> Column:
        return F.when(search.gate, bind(search.text, lambda text: cut_at_matches(text, search.pattern)))

    pieces = F.array(*[cut(search) for search in searches])
    short = F.array(*[F.lit(s.short) for s in searches])
    return F.transform(pieces, lambda p, i: F.coalesce(hits_in(p, F.get(short, i)), empty_array(HIT)))
