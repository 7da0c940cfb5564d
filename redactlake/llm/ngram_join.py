"""Documents whose sets of word n-grams have a Jaccard similarity of at least a given percentage.

Equal sets are one class from the start. Sets fall into bands of sizes; only sets of the same or of neighbouring bands can
link. Within a pair of bands a set's n-grams are dealt by hash into more parts than a linked pair can differ in, so that a
linked pair has a part in common: sets of one band and with one part in common are a tile. Few sets share some five to ten
n-grams by chance, so that frequent n-grams don't matter.

Tiles of a few sets give all their pairs. Larger ones first give the pairs of each set with the tile's first set and with its
predecessor; when these links are known, only sets of different components are still compared, in blocks: first by bitmaps alone,
then the sets that may link by their texts; each block gives out a spanning forest of the links it finds. A pair is first judged by hashed bitmaps: a bit tells whether
an odd number of n-grams falls on it, so that n-grams which both sets hold cancel out; the number of differing bits bounds the
difference from below, hence the overlap from above. Pairs that pass are intersected as sorted arrays. No link that joins
different components is lost, and a group of near copies gives links in proportion to its sets, not to its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.components import components
from redactlake.llm.members import likely_members
from redactlake.llm.store import Scratch
from redactlake.llm.texts import encoded, slices

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Sets of a tile that give all their pairs; n-grams that the targets and the probes in a block of a larger one have, about.
SMALL_TILE, TARGETS, PROBES = 8, 1 << 19, 1 << 18
#: Pairs that may link which a block gives out for each of its members, at most; with more of them it gives out the members.
PAIRS_A_MEMBER = 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def ngram_set(text: bytes, length: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words, A-Z in lower case; of a shorter text all words as one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(length, len(words))
    grams = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        grams = mixed(grams + hashes[i : len(grams) + i])
    return np.unique(grams)


class Rule:
    """When two sets link: 100 * overlap >= percent * union, that is (100 + percent) * difference <= (100 - percent) * sizes.

    `frequent`: sorted n-grams that many sets hold. Any choice gives the same links.
    """

    def __init__(self, length: int, percent: int, frequent: np.ndarray | None = None):
        self.length, self.percent = length, percent
        self.frequent = np.zeros(0, np.uint64) if frequent is None else frequent

    def differing(self, sizes: int) -> int:
        """The most n-grams in which two linked sets differ whose sizes add up to `sizes`."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    @functools.cached_property
    def bounds(self) -> np.ndarray:
        """The least size of each band."""
        own = [1]
        while own[-1] < 1 << 40:
            own.append(100 * own[-1] // self.percent + 1)
        return np.array(own)

    def parts(self, band: int) -> tuple[int, int]:
        """How many parts sets have when the larger one is in `band`, and how many of them may stay unsaid.

        Linked sets have more parts in common than may stay unsaid. A part without n-grams, or with frequent ones only, says
        little; a set leaves such parts out if they are few enough, and both linked sets have those that they share.
        """
        most = self.differing(2 * int(self.bounds[band + 1] - 1))
        slack = 1 + most // 16
        return (most + 1 + slack, slack) if most else (0, 0)

    @property
    def bits(self) -> int:
        """Bits per n-gram of a bitmap, at least: with them sets without a common n-gram, which differ in about half the bits, differ in
        twice as many as linked sets may."""
        return max(1, -(-9 * (100 - self.percent) // (100 + self.percent)))

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """The set's parts, as numbers that are equal for equal parts of one band."""
        if not len(grams):
            return np.zeros(0, np.uint64)
        own = int(np.searchsorted(self.bounds, len(grams), "right")) - 1
        rare, out = ~np.isin(grams, self.frequent), []
        for band in (own, own + 1):
            parts, slack = self.parts(band)
            if not parts:
                continue
            values = mixed(grams + STEP)
            of = ((values >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, of, values)
            filled = np.bincount(of, weights=rare, minlength=parts) > 0
            kept = np.flatnonzero(filled | ((~filled).sum() > slack))
            out.append(mixed(mixed(sums[kept] + kept.astype(np.uint64) * STEP) + np.uint64(band + 1)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        overlap = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * overlap >= self.percent * (len(a) + len(b) - overlap)


def bitmap(grams: np.ndarray, bits: int = 1) -> bytes:
    """At least `bits` bits per n-gram, a power of two: whether an odd number of the n-grams falls on each."""
    width = 1 << max(6, int(bits * len(grams) - 1).bit_length())
    counts = np.bincount((mixed(grams) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """The bitmap with `width` bytes that the same n-grams have."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0)


def frequent_ngrams(docs: DataFrame, length: int, sample: int = 4096, least: int = 8, most: int = 1 << 16) -> np.ndarray:
    """N-grams that at least `least` of some `sample` texts hold, the most frequent `most` of them, sorted. The sample only
    decides how many candidates there are; links don't depend on it."""
    every = max(1, docs.count() // sample)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = [ngram_set(text, length) for text in encoded(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["gram"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counted = chosen.mapInArrow(grams, "gram bigint").groupBy("gram").count().where(F.col("count") >= least)
    top = counted.orderBy(F.desc("count"), "gram").limit(most).select("gram").toArrow()
    return np.sort(top.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _profiles(rule: Rule):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [ngram_set(text, rule.length) for text in encoded(part.column("text"))]
                prints = [xxhash.xxh3_128_digest(own.tobytes()) for own in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(own) for own in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array([rule.signatures(own).tobytes() for own in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "print", "signatures"],
                )

    return profile


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            own = [np.frombuffer(s, np.int64) for s in part.column("signatures").to_pylist()]
            ids = np.repeat(part.column("rep").to_numpy(), [len(s) for s in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(ids)], ["tile", "rep"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tile, rep) to pairs (null, a, b) and to members of larger tiles (tile, rep, null).

    The first and the last tile of a partition may go on in another one, so that their members are given out as well.
    """
    carry = None  # rows of the tile that the next batch may go on with
    first = True

    def split(tile: np.ndarray, rep: np.ndarray, last: bool, began: bool) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        sizes = np.diff(np.append(begins, len(tile)))
        a, b = [], []
        for gap in range(1, SMALL_TILE):  # all pairs of small tiles
            at = np.arange(len(tile) - gap)
            of = np.repeat(np.arange(len(begins)), sizes)
            near = (tile[at] == tile[at + gap]) & (sizes[of[at]] <= SMALL_TILE)
            a.append(rep[at[near]])
            b.append(rep[at[near] + gap])
        of = np.repeat(np.arange(len(begins)), sizes)
        large = sizes > SMALL_TILE
        at = np.flatnonzero(large[of])
        later = at[at != begins[of[at]]]
        a += [rep[begins[of[later]]], rep[later - 1]]
        b += [rep[later], rep[later]]
        large[-1] |= last
        large[0] |= began
        members = large[of]
        a, b = np.concatenate(a), np.concatenate(b)
        differ = a != b
        a, b = a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        n = int(members.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(len(low), pa.int64()), pa.array(tile[members])]),
                pa.concat_arrays([pa.array(low), pa.array(rep[members])]),
                pa.concat_arrays([pa.array(high), pa.nulls(n, pa.int64())]),
            ],
            ["tile", "a", "b"],
        )

    for batch in batches:
        tile, rep = batch.column("tile").to_numpy(), batch.column("rep").to_numpy()
        if not len(tile):
            continue
        if carry is not None:
            tile, rep = np.concatenate([carry[0], tile]), np.concatenate([carry[1], rep])
        # all but the last tile are whole; a tile longer than a batch is given out in fragments, as members
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut == 0 and len(tile) > 100_000:
            yield split(tile, rep, True, True)
            carry, first = (tile[:0], rep[:0]), True
            continue
        if cut:
            yield split(tile[:cut], rep[:cut], False, first)
            first = False
        carry = tile[cut:], rep[cut:]
    if carry is not None and len(carry[0]):
        yield split(*carry, True, first)


def _bitmaps(rule: Rule):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [ngram_set(text, rule.length) for text in encoded(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in sets], pa.binary()),
                        pa.array([len(own) for own in sets], pa.int64()),
                        part.column("text"),
                        pa.array([bitmap(own, rule.bits) for own in sets], pa.binary()),
                    ],
                    ["rep", "print", "n", "text", "bits"],
                )

    return describe


def _bounded(rule: Rule):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            kept = []
            for i, (x, y) in enumerate(zip(rows["bits_a"], rows["bits_b"], strict=True)):
                width = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                kept.append(differ <= rule.differing(rows["n_a"][i] + rows["n_b"][i]))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return bound


def _intersected(rule: Rule):
    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = functools.lru_cache(256)(lambda text: ngram_set(text, rule.length))
        for batch in batches:
            pairs = zip(encoded(batch.column("text_a")), encoded(batch.column("text_b")), strict=True)
            kept = [rule.linked(cached(a), cached(b)) for a, b in pairs]
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return intersect


def _overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many n-grams of a sorted array each of some others has; none is empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def spanning(sets: list[np.ndarray], labels: np.ndarray, probe: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links (positions) of a probe and a target of different components that join all components which such links join.

    Each link given out joins two components of the block, so that there are fewer links than components.
    """
    labels, out = labels.copy(), []
    sizes = np.array([len(own) for own in sets], np.int64)
    targets = np.flatnonzero(~probe)
    for p in np.flatnonzero(probe).tolist():
        apart = targets[labels[targets] != labels[p]]
        fit = rule.percent * np.maximum(sizes[apart], sizes[p]) <= 100 * np.minimum(sizes[apart], sizes[p])
        apart = apart[fit]
        if not len(apart):
            continue
        both = _overlaps(sets[p], [sets[t] for t in apart.tolist()])
        for t in apart[100 * both >= rule.percent * (sizes[apart] + sizes[p] - both)].tolist():
            if labels[t] != labels[p]:
                out.append((p, t))
                labels[labels == labels[t]] = labels[p]
    return out


MEMBER = "tile bigint, block bigint, probe_block bigint, rep bigint, label bigint, probe boolean"


def _involved(rule: Rule):
    """Of one block of a large tile the pairs (rep, other) of different components that may link, as far as bitmaps can tell. Where these
    are many, the members of such pairs, without other."""

    def involve(group: pa.Table) -> pa.Table:
        bits = group.column("bits").to_pylist()
        width = min(map(len, bits), default=8)
        maps = np.array([folded(own, width) for own in bits]).view(np.uint64)
        labels, sizes, probe = (group.column(c).to_numpy() for c in ("label", "n", "probe"))
        targets, found = np.flatnonzero(~probe), np.zeros(len(bits), bool)
        pairs, most, n = [], PAIRS_A_MEMBER * len(bits), 0
        for p in np.flatnonzero(probe).tolist():
            differ = np.bitwise_count(maps[targets] ^ maps[p]).sum(1, dtype=np.int64)
            near = differ * (100 + rule.percent) <= (100 - rule.percent) * (sizes[targets] + sizes[p])
            near &= labels[targets] != labels[p]
            found[targets[near]] = True
            found[p] = near.any()
            n += int(near.sum())
            if n <= most:
                pairs += [(p, t) for t in targets[near].tolist()]
        fields = [field.split()[0] for field in MEMBER.split(", ")]
        if n > most:
            members = group.filter(pa.array(found)).select(fields)
            return members.append_column("other", pa.nulls(members.num_rows, pa.int64()))
        one, other = np.array(pairs, np.int64).reshape(-1, 2).T
        chosen = group.select(fields).take(pa.array(one))
        return chosen.append_column("other", pa.array(group.column("rep").to_numpy()[other]))

    return involve


def _crossed(rule: Rule):
    """The members of a block that may link to the links that join its components."""

    def cross(group: pa.Table) -> pa.Table:
        sets = [ngram_set(text, rule.length) for column in group.column("text").chunks for text in encoded(column)]
        ids, labels, probe = (group.column(c).to_numpy() for c in ("rep", "label", "probe"))
        links = np.array(spanning(sets, labels, probe, rule), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[links].min(1), "b": ids[links].max(1)})

    return cross


def ngram_links(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles (size of its set), component_id (the smallest doc_id that
    links reach, itself included).

    A set holds a text's distinct n-grams of `length` words, A-Z in lower case; a text with fewer words has all of them as one.
    Two rows link when 100 * overlap >= percent * union of their sets (`percent` from 50 to 100). Null texts and texts without words have the
    empty set and link with nothing: their component is their own doc_id. Rows with the same doc_id are rows of their own that
    may link with each other. A row without doc_id has the component of the rows with the same set, or null. Other columns
    are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rule = Rule(length, percent, frequent_ngrams(rows, length))
    schema = "doc_id bigint, n_shingles bigint, print binary, signatures binary"
    profiles = scratch.keep(rows.mapInArrow(_profiles(rule), schema), "profiles")
    narrow = scratch.keep(profiles.drop("signatures"), "narrow")
    some = narrow.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.keep(some.groupBy("print").agg(F.min("doc_id").alias("rep")), "reps")
    # a copy that passes as likely is one more set that links with its class
    said = profiles.where("length(signatures) > 0 and doc_id is not null").select(F.col("doc_id").alias("rep"), "signatures")
    several = likely_members(said, "rep", reps.select("rep"))
    spread = several.mapInArrow(_exploded, "tile bigint, rep bigint").repartitionByRange("tile", "rep")
    found = scratch.keep(
        spread.sortWithinPartitions("tile", "rep").mapInArrow(_tiles, "tile bigint, a bigint, b bigint"), "found"
    )
    scratch.drop("profiles")
    pairs = scratch.keep(found.where("tile is null").select("a", "b").distinct(), "pairs")
    members = scratch.keep(found.where("tile is not null").select("tile", F.col("a").alias("rep")), "members")
    used = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(members.select("rep")).distinct()
    used = scratch.keep(used, "used")
    # sets that pass as likely without being used are in no pair and no tile, so that no join meets them
    texts = scratch.keep(
        likely_members(rows, "doc_id", used)
        .mapInArrow(_bitmaps(rule), "rep bigint, print binary, n bigint, text string, bits binary")
        .dropDuplicates(["rep", "print"]),
        "texts",
    )

    def side(sets: DataFrame, name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """The texts of the sets in `ids` (rep), and a few others: a join then shuffles no more than these."""
        return likely_members(texts.select("rep", "text"), "rep", scratch.keep(ids.distinct(), f"{name}-ids"))

    def verified(likely: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link, by intersection."""
        own = texts_of(likely.select(F.col("a").alias("rep")).union(likely.select("b")), name)
        compared = likely.join(side(own, "a", "text"), "a").join(side(own, "b", "text"), "b")
        return scratch.keep(compared.mapInArrow(_intersected(rule), "a bigint, b bigint"), name)

    def linked(candidates: DataFrame, name: str) -> DataFrame:
        """The candidates (a, b) that link: first by bitmaps, then by intersection."""
        judged = candidates.join(side(texts, "a", "n", "bits"), "a").join(side(texts, "b", "n", "bits"), "b")
        return verified(scratch.keep(judged.mapInArrow(_bounded(rule), "a bigint, b bigint"), f"{name}-likely"), name)

    classes = narrow.where("n_shingles > 0 and doc_id is not null").join(reps.select("print", "rep"), "print")
    # rows with the same id in several classes hold these together
    repeated = (
        classes.groupBy("doc_id")
        .agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
        .where("least != most")
        .select("doc_id")
    )
    same_id = classes.join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = linked(pairs, "links").unionByName(same_id)
    labels = components(links, scratch, "first")
    labelled = members.join(labels, members["rep"] == labels["id"], "left").select(
        "tile", "rep", F.coalesce("component", "rep").alias("label")
    ).join(texts.select("rep", "n"), "rep")
    by_label = labelled.groupBy("tile", "label").agg(F.count("*").alias("count"), F.sum("n").alias("grams"))
    main = F.max_by(F.struct("label", "grams", "count"), F.struct("count", "label")).alias("main")
    opened = scratch.keep(
        by_label.groupBy("tile")
        .agg(main, F.sum("count").alias("size"), F.sum("grams").alias("grams"))
        .where("size > main.count")
        .select("tile", F.col("main.label").alias("main"), "size", "grams", (F.col("grams") - F.col("main.grams")).alias("others")),
        "opened",
    )
    blocks = F.least(F.ceil(F.col("grams") / TARGETS), F.col("size"))
    probe_blocks = F.least(F.ceil(F.col("others") / PROBES), F.col("size"))
    own, all_of = F.xxhash64("rep"), lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    placed = labelled.join(opened, "tile")
    targets = placed.select("tile", "rep", "label", F.pmod(own, blocks).alias("block"), probe_blocks.alias("k"))
    targets = targets.select("tile", "block", all_of(F.col("k")).alias("probe_block"), "rep", "label", F.lit(False).alias("probe"))
    probes = placed.where("label != main").select("tile", "rep", "label", F.pmod(own, probe_blocks).alias("probe_block"), blocks.alias("k"))
    probes = probes.select("tile", all_of(F.col("k")).alias("block"), "probe_block", "rep", "label", F.lit(True).alias("probe"))
    cell = ["tile", "block", "probe_block"]
    judged = targets.unionByName(probes).join(texts.select("rep", "n", "bits"), "rep").groupBy(*cell)
    involved = scratch.keep(judged.applyInArrow(_involved(rule), f"{MEMBER}, other bigint"), "involved")
    # the same pair comes out of every tile that both sets are in; its texts are sent once
    met = involved.where("other is not null").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    met = verified(scratch.keep(met.distinct(), "met"), "met-links")
    crowded = involved.where("other is null").drop("other")
    crossing = (
        crowded.join(texts_of(crowded.select("rep"), "crowded"), "rep").groupBy(*cell).applyInArrow(_crossed(rule), "a bigint, b bigint")
    )
    late = scratch.keep(crossing.unionByName(met).distinct(), "late")
    final = components(late.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch, "final")
    placed_classes = scratch.keep(
        reps.select("print", "rep").join(final, F.col("rep") == F.col("id"), "left").select(
            "print", F.coalesce("component", "rep").alias("component")
        ),
        "classes",
    )
    return narrow.join(placed_classes, "print", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
