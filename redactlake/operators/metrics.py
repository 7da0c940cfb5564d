"""Counters over request summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_PREFIX = "pii_scan"


def totals(summaries: DataFrame) -> DataFrame:
    """Requests, findings and masked bytes."""
    return summaries.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("pii_found"), F.lit(0)).cast("bigint").alias("findings"),
        F.coalesce(F.sum("masked_bytes"), F.lit(0)).cast("bigint").alias("masked_bytes"),
    )


def by_type(summaries: DataFrame) -> DataFrame:
    """Plus one per entry of each type list; counted per partition before the shuffle."""
    return (
        summaries.select(F.explode_outer("pii_types").alias("pii_type"))
        .where(F.col("pii_type").isNotNull())
        .groupBy("pii_type")
        .agg(F.count("*").alias("n"))
    )


def exposition(summaries: DataFrame, prefix: str = METRIC_PREFIX) -> DataFrame:
    """Counters as text lines (line_no, value), types in alphabetical order.

    One pass over the summaries: each request gives a row per type and one with its totals, all counted by name.
    """
    counters = F.array(
        F.struct(F.lit("requests").alias("name"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("pii_findings").alias("name"), F.col("pii_found").alias("n")),
        F.struct(F.lit("masked_bytes").alias("name"), F.col("masked_bytes").alias("n")),
    )
    types = F.transform(
        "pii_types", lambda t: F.struct(F.concat(F.lit("type:"), t).alias("name"), F.lit(1).cast("bigint").alias("n"))
    )
    # a zero row per counter, so that an empty input still gives its three lines
    zero = summaries.sparkSession.createDataFrame(
        [("requests", 0), ("pii_findings", 0), ("masked_bytes", 0)], "name string, n bigint"
    )
    counted = (
        summaries.select(F.explode(F.concat(counters, types)).alias("c"))
        .select("c.name", "c.n")
        .unionByName(zero)
        .groupBy("name")
        .agg(F.sum("n").alias("n"))
    )
    order = F.create_map(
        *[F.lit(v) for v in ("requests", 0, "pii_findings", 2, "masked_bytes", 4)]
    )
    place = order[F.col("name")]
    metric = F.format_string(f"{prefix}_%s_total", "name")
    lines = F.when(
        place.isNotNull(),
        F.array(
            F.struct(place.alias("no"), F.concat(F.lit("# TYPE "), metric, F.lit(" counter")).alias("value")),
            F.struct((place + 1).alias("no"), F.format_string("%s %d", metric, F.col("n")).alias("value")),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.lit(6).alias("no"),
                F.format_string(f'{prefix}_pii_type_total{{type="%s"}} %d', F.expr("substr(name, 6)"), F.col("n")).alias(
                    "value"
                ),
            )
        )
    )
    rows = counted.select(F.explode(lines).alias("l")).select("l.no", "l.value")
    # at most one row per counter and type is left here
    position = F.row_number().over(Window.orderBy("no", "value"))
    return rows.select(position.alias("line_no"), "value")

