"""Call identity, rate limit and key check over tables of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.operators.joins import with_lookup


def presented_key(api_key: Column, authorization: Column) -> Column:
    """The key header, else the bearer token; NULL if there is neither."""
    bearer = F.when(F.startswith(authorization, F.lit("Bearer ")), F.substr(authorization, F.lit(8)))
    key = F.when(F.coalesce(api_key, F.lit("")) != "", api_key).otherwise(bearer)
    return F.when(key != "", key)


def rate_key(api_key: Column, authorization: Column, remote_addr: Column) -> Column:
    """``k:`` and the hash of the key, else ``ip:`` and the host; an address that is not host:port stays whole."""
    host = F.regexp_replace(remote_addr, r"^(?:\[([^\[\]]*)\]|([^:\[\]]*)):[^:\[\]]*$", "$1$2")
    key = presented_key(api_key, authorization)
    return F.coalesce(F.concat(F.lit("k:"), F.sha2(key, 256)), F.concat(F.lit("ip:"), host))


def admit(
    calls: DataFrame, key: str = "rate_key", ts: str = "ts", seq: str = "seq", limit: int = fv.CALLS_PER_MINUTE
) -> DataFrame:
    """Add ``admitted``: the first ``limit`` calls of a key in a minute, in order of arrival.

    Only the last admitted call of each full minute is looked for: for that, Spark keeps ``limit`` rows per key,
    minute and partition before it shuffles. The calls are then compared with it, so that no task has to sort all
    calls of a busy key; minutes that stay below the limit need no comparison.
    """
    minute = calls.withColumn("_minute", F.date_trunc("minute", F.col(ts)))
    window = Window.partitionBy(key, "_minute").orderBy(ts, seq)
    last = (
        minute.select(key, "_minute", ts, seq)
        .withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") == limit)
        .select(key, "_minute", F.struct(F.col(ts), F.col(seq)).alias("_last"))
    )
    return (
        minute.join(last, [key, "_minute"], "left")
        .withColumn("admitted", F.col("_last").isNull() | (F.struct(F.col(ts), F.col(seq)) <= F.col("_last")))
        .drop("_minute", "_last")
    )


def admit_keys(calls: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Add ``admitted``: calls whose key has a known hash. With no hashes stored, all calls pass."""
    known = keys.where(F.col("hash") != "").select(F.col("hash").alias("_hash"), F.lit(True).alias("_known")).distinct()
    if known.isEmpty():
        return calls.withColumn("admitted", F.lit(True))
    hashed = calls.withColumn("_hash", F.sha2(key, 256))
    joined = with_lookup(hashed, known, "_hash")
    return joined.withColumn("admitted", F.coalesce("_known", F.lit(False))).drop("_hash", "_known")
