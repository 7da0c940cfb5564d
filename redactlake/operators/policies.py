"""Policies: which detectors and whitelist apply to which traffic source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactlake.operators.joins import with_lookup
from redactlake.operators.requests import mask_by_policy

SETTINGS = ["detectors", "whitelist", "dry_run"]


def one_per_port(policies: DataFrame, *order: str) -> DataFrame:
    """One policy per port: the first one by the columns of ``order``, then by its settings."""
    first = F.min(F.struct(*order, *SETTINGS)).alias("_first")
    return policies.where("port is not null").groupBy("port").agg(first).select("port", *[f"_first.{c}" for c in SETTINGS])


def apply_policies(requests: DataFrame, policies: DataFrame, body: str = "body", order: tuple[str, ...] = ()) -> DataFrame:
    """Mask each request by the policy of its port; a policy may also ask for a dry run.

    ``requests``: port and a body; ``policies``: port, detectors, whitelist, dry_run. Of several policies for a port the first
    one by ``order`` counts, so that no request is doubled. Requests without a policy run all detectors with an empty
    whitelist. Policies are keyed by a 16-bit port, so they stay small.
    """
    joined = with_lookup(requests, one_per_port(policies, *order), "port")
    return mask_by_policy(joined, body).drop(*SETTINGS)


def with_policy_as_of(
    requests: DataFrame, versions: DataFrame, ts: str = "ts", valid_from: str = "valid_from", slice_seconds: int = 3600
) -> DataFrame:
    """Add version, detectors, whitelist and dry_run: those of the port's policy at the time of the request.

    ``versions``: port, valid_from, version and the settings. A version holds from its time on, that instant included, until the port's next one;
    of several with the same time the one with the greatest version counts. Before a port's first version, for a port or
    time that is NULL, and while a version is in force whose settings are all NULL (a withdrawn policy), the added columns are NULL.

    Time is cut into slices. For each slice in which a port has requests the version at its beginning is carried in; the windows see
    only versions and slices, not requests. Requests then join the few intervals of their own port and slice, so that those of
    a busy port meet in no single task.
    """
    micros = lambda column: F.unix_micros(F.col(column).cast("timestamp"))
    width = slice_seconds * 1_000_000
    slice_of = lambda at: F.floor(at / F.lit(width)).cast("bigint")
    settings = F.struct("version", *SETTINGS)
    starts = (
        versions.where(F.col("port").isNotNull() & F.col(valid_from).isNotNull())
        .select("port", micros(valid_from).alias("_from"), settings.alias("_policy"))
        .groupBy("port", "_from")
        .agg(F.max_by("_policy", F.struct("_policy.version", F.to_json("_policy"))).alias("_policy"))
    )
    timed = requests.withColumn("_at", micros(ts)).withColumn("_slice", slice_of(F.col("_at")))
    asked = timed.where(F.col("port").isNotNull() & F.col("_slice").isNotNull()).select("port", "_slice").distinct()
    slices = asked.select("port", (F.col("_slice") * width).alias("_from"), "_slice", F.lit(0).alias("_order"))
    events = slices.unionByName(starts.withColumn("_order", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("port").orderBy("_from", "_order")
    carried = (
        events.withColumn("_policy", F.last("_policy", ignorenulls=True).over(before)).where("_order = 0").drop("_order")
    )
    inside = starts.withColumn("_slice", slice_of(F.col("_from"))).join(asked, ["port", "_slice"], "left_semi")
    following = Window.partitionBy("port", "_slice").orderBy("_from", "_order")
    intervals = (
        carried.withColumn("_order", F.lit(0))
        .unionByName(inside.withColumn("_order", F.lit(1)))
        .withColumn("_until", F.lead("_from").over(following))
        .where(F.col("_policy").isNotNull())
        .select(*[F.col(c).alias(f"_p{c.removeprefix('_')}") for c in ("port", "_slice", "_from", "_until", "_policy")])
    )
    same = (
        (F.col("port") == F.col("_pport"))
        & (F.col("_slice") == F.col("_pslice"))
        & (F.col("_at") >= F.col("_pfrom"))
        & (F.col("_puntil").isNull() | (F.col("_at") < F.col("_puntil")))
    )
    joined = timed.join(intervals, same, "left")
    return joined.select(*requests.columns, *[F.col(f"_ppolicy.{c}").alias(c) for c in ("version", *SETTINGS)])


def apply_policies_as_of(requests: DataFrame, versions: DataFrame, body: str = "body", **times) -> DataFrame:
    """Mask each request by the policy that its port had at its time (``with_policy_as_of``); without one all detectors run."""
    return mask_by_policy(with_policy_as_of(requests, versions, **times), body).drop(*SETTINGS)
