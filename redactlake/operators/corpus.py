"""What a corpus holds as a whole: profiles, shared values, top documents, a clean part. All work on a findings table
(scan_id, pii_type, text) and need one shuffle each, with partial sums in front of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions.spans import mask


def profile(findings: DataFrame, groups: DataFrame, group: str, key: str = "scan_id") -> DataFrame:
    """Findings and affected documents per group and type with all subtotals: ``group``, pii_type, level, findings, docs.

    ``groups``: the key and the group of each document. ``level`` has a bit for each of the two that is summed over.
    """
    per_document = findings.groupBy(key, "pii_type").agg(F.count("*").alias("n")).join(groups.select(key, group), key)
    return (
        per_document.cube(group, "pii_type")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("n").alias("findings"),
            F.count_distinct(key).alias("docs"),
        )
        .select(group, "pii_type", "level", "findings", "docs")
    )


def pseudonyms(findings: DataFrame, key: str = "scan_id", length: int = 16) -> DataFrame:
    """One name per type and text for the whole corpus, from their hash: no order over all texts is needed, and later corpora get the
    same names. With 16 hexadecimal digits two of a hundred million texts share a name with a chance of 1 in 3,700."""
    return findings.groupBy("pii_type", "text").agg(F.count_distinct(key).alias("docs")).select(
        "pii_type",
        "text",
        F.concat(
            F.lit("["), "pii_type", F.lit("_"),
            F.substring(F.sha2(F.concat("pii_type", F.lit(":"), "text"), 256), 1, length), F.lit("]"),
        ).alias("pseudonym"),
        "docs",
    )


def first_places(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """pii_type, text, docs, and where the text stands first (``key``, start), dealt by ranges of type and place: ``part`` numbers the
    range. Write this table before it is numbered, so that ranges stay as they are."""
    values = findings.groupBy("pii_type", "text").agg(
        F.count_distinct(key).alias("docs"), F.min(F.struct(key, "start")).alias("first")
    )
    placed = values.select("pii_type", "text", "docs", F.col(f"first.{key}").alias("first_key"), "first.start")
    return placed.repartitionByRange("pii_type", "first_key", "start", "text").withColumn("part", F.spark_partition_id())


def numbered_pseudonyms(places: DataFrame) -> DataFrame:
    """pii_type, text, pseudonym, docs: ``[TYPE_n]`` with n by first document, then place, over the whole corpus.

    ``places``: the table of ``first_places``, written. Ranks come in two levels: counts of each range, summed up over the ranges
    before it, and ranks inside each range; the values of a type never meet in one task.
    """
    sizes = places.groupBy("pii_type", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("pii_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pii_type", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("pii_type", "part").orderBy("first_key", "start", "text"))
    number = (F.col("offset") + F.col("inside")).cast("string")
    return places.withColumn("inside", inside).join(offsets, ["pii_type", "part"]).select(
        "pii_type", "text", F.concat(F.lit("["), "pii_type", F.lit("_"), number, F.lit("]")).alias("pseudonym"), "docs"
    )


#: A value is common if more than one in this many of the documents with findings has it.
COMMON = 1000


def mask_by_pseudonyms(scanned: DataFrame, pseudonyms: DataFrame, key: str = "scan_id", text: str = "text") -> DataFrame:
    """Add ``masked_text``: the texts with every finding replaced by its pseudonym (pii_type, text, pseudonym, docs).

    ``scanned``: a key that no two rows share, the text and its findings. Findings meet their pseudonym by value. Common values are
    joined first: they are at most COMMON times as many as a document has findings on average, so that Spark can normally send
    them to all tasks. The shuffle of all others then has no busy key. Texts are put together from their spans again; those without
    findings are not shuffled. A value without pseudonym keeps its placeholder.
    """
    some = F.size("findings") > 0
    spans = scanned.where(some).select(key, F.explode("findings").alias("finding"))
    by_value = spans.withColumn("_type", F.col("finding.pii_type")).withColumn("_value", F.col("finding.text"))
    told = pseudonyms.select(
        F.col("pii_type").alias("_type"), F.col("text").alias("_value"), F.col("pseudonym").alias("_name"), F.col("docs").alias("_docs")
    )
    total = scanned.where(some).count()
    common = told.where(F.col("_docs") * COMMON > total).drop("_docs")
    others = told.where(F.col("_docs") * COMMON <= total).drop("_docs")
    first = by_value.join(common, ["_type", "_value"], "left")
    named = first.where(F.col("_name").isNotNull()).unionByName(
        first.where(F.col("_name").isNull()).drop("_name").join(others, ["_type", "_value"], "left")
    )
    renamed = F.col("finding").withField("placeholder", F.coalesce("_name", "finding.placeholder"))
    collected = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("finding.start", renamed.alias("finding")))).alias("_spans"))
    whole = scanned.where(some).join(collected, key)
    masked = whole.withColumn("masked_text", mask(F.col(text), F.transform("_spans", lambda s: s["finding"]))).drop("_spans")
    return masked.unionByName(scanned.where(~F.coalesce(some, F.lit(False))).withColumn("masked_text", F.col(text)))


def shared_values(findings: DataFrame, key: str = "scan_id", least: int = 2) -> DataFrame:
    """Texts found in several documents: pii_type, text, docs."""
    counted = findings.groupBy("pii_type", "text").agg(F.count_distinct(key).alias("docs"))
    return counted.where(F.col("docs") >= least)


#: Sketches of 2^16 registers: counts up to 6,000 come out exactly but for collisions of 26-bit hashes, larger ones with a standard error of
#: 0.41 % (1.04 / sqrt(2^16)); a sketch grows with its count up to 64 KB.
SKETCH_BITS = 16


def value_sketches(findings: DataFrame, day: str = "day", key: str = "scan_id", bits: int = SKETCH_BITS) -> DataFrame:
    """Which documents hold a value, by day, as mergeable sketches: day, pii_type, text, sketch. Written once a day, the table answers for
    any range of days without the findings; a document that comes on several days counts once. A value in very many documents is
    summed up in every partition before it is shuffled, as one sketch."""
    hashed = F.xxhash64(F.col(key))
    return findings.groupBy(day, "pii_type", "text").agg(F.hll_sketch_agg(hashed, F.lit(bits)).alias("sketch"))


def shared_by_sketches(sketches: DataFrame, least: int = 2) -> DataFrame:
    """Texts found in several documents: pii_type, text, docs (estimated), days. ``sketches``: the days that are asked for."""
    merged = sketches.groupBy("pii_type", "text").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("docs"), F.count("*").alias("days")
    )
    return merged.where(F.col("docs") >= least)


def top_documents(findings: DataFrame, k: int, key: str = "scan_id") -> DataFrame:
    """The ``k`` documents with most findings, the smaller key first: key, n_findings."""
    counted = findings.groupBy(key).agg(F.count("*").alias("n_findings"))
    return counted.orderBy(F.desc("n_findings"), key).limit(k)


def clean_split(scanned: DataFrame, labels: DataFrame, key: str = "scan_id") -> DataFrame:
    """Every document with ``clean`` (nothing found) and its labels, where it has some."""
    split = scanned.select(key, (F.size("findings") == 0).alias("clean"))
    return split.join(labels, key, "left")
