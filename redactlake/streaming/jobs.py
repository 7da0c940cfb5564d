"""Streaming forms of the scan, the counters and the rate limit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from redactlake import fixed_values as fv
from redactlake.functions.scan import ScanOptions
from redactlake.operators.scans import explode_array, explode_findings, placeholder_map, scan_texts, spread


def read_stream(spark: SparkSession, folder: str, file_glob: str) -> DataFrame:
    """Parquet files of a folder as a stream. What the glob finds may also be folders of files, as tables in several parts are."""
    schema = spark.read.parquet(f"{folder}/{file_glob}").schema
    # braces make a plain name a glob too: a path that is none has to be a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{file_glob}}}")


#: Default trigger: until the input that is there now is used up. ``{"processingTime": "10 seconds"}`` runs on.
DRAIN = {"availableNow": True}


def write_stream(df: DataFrame, path: str, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
    """Append to parquet files, exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def scan_stream(texts: DataFrame, text: str = "text", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Mask a stream of texts: stateless, in the row."""
    return scan_texts(texts, text, options)


def write_scan(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    select: Callable[[DataFrame], DataFrame],
    text: str = "text",
    options: ScanOptions = ScanOptions(),
    trigger: dict = DRAIN,
) -> StreamingQuery:
    """Mask a stream batch by batch, so that a batch made of one small file is spread over all cores.

    Every batch has a folder of its own that a repeated batch overwrites, so each text counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scanned = scan_texts(spread(batch), text, options)
        select(scanned).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _each_batch(texts, write, checkpoint, trigger)


def _each_batch(
    texts: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    return (
        texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def write_counts(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    ts: str = "ts",
    text: str = "text",
    options: ScanOptions = ScanOptions(),
    trigger: dict = DRAIN,
) -> StreamingQuery:
    """Findings per type and minute of event time, as one set of partial counts per batch; ``read_counts`` adds them up.

    A batch overwrites its own folder when it is repeated, so each text counts once. There is no state and no watermark:
    the last minutes are complete, and texts that come late count in their minute however late they are. One row per batch in ``_seen``
    tells its number of texts, its latest time, and the latest of all batches before it, for ``read_windows``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = explode_array(scan_texts(spread(batch), text, options), "findings", [ts], ["pii_type"])
        counts = found.groupBy(F.date_trunc("minute", ts).alias("minute"), "pii_type").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        before = None
        if batch_id:
            row = spark.read.parquet(f"{path}/_seen/batch={batch_id - 1}").select(F.unix_micros(F.greatest("last", "last_before"))).first()
            before = row[0]
        # reads the times alone; an observed metric would be lost where nothing is found and the plan turns out empty
        seen = batch.agg(
            F.max(ts).alias("last"),
            F.timestamp_micros(F.lit(before).cast("bigint")).alias("last_before"),
            F.count(F.lit(1)).alias("texts"),
        )
        seen.write.mode("overwrite").parquet(f"{path}/_seen/batch={batch_id}")

    return _each_batch(texts, write, checkpoint, trigger)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """minute, pii_type, n over all batches of ``write_counts`` so far."""
    return spark.read.parquet(path).groupBy("minute", "pii_type").agg(F.sum("n").alias("n"))


def read_windows(spark: SparkSession, path: str, lateness: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    """Windows of event time over ``write_counts``, with the late findings told apart: minute, pii_type, n, late, closed.

    The watermark of a batch is the latest time in the batches before it, less ``lateness``. Findings whose minute ended by then are counted in
    ``late``, all others in ``n``; a minute that ended by the watermark after the last batch is ``closed``, and its ``n`` is final.
    Nothing is dropped, and another lateness needs no second run.
    """
    counts = spark.read.parquet(path)
    seen = spark.read.parquet(f"{path}/_seen")
    allowed, length = F.expr(f"interval {lateness}"), F.expr(f"interval {size}")
    reached = seen.agg(F.max(F.greatest("last", "last_before")).alias("reached"))
    ended = F.col("minute") + length
    late = F.coalesce(ended <= F.col("last_before") - allowed, F.lit(False))
    told = counts.join(seen.select("batch", "last_before"), "batch").withColumn("is_late", late)
    sums = told.groupBy("minute", "pii_type").agg(
        F.coalesce(F.sum(F.when(~F.col("is_late"), F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("is_late"), F.col("n"))), F.lit(0)).alias("late"),
    )
    last = reached.first()["reached"]
    closed = F.coalesce(ended <= F.lit(last).cast("timestamp") - allowed, F.lit(False))
    return sums.select("minute", "pii_type", "n", "late", closed.alias("closed"))


def admit_stream(
    calls: DataFrame,
    key: str = "rate_key",
    ts: str = "ts",
    seq: str = "seq",
    limit: int = fv.CALLS_PER_MINUTE,
    keep_ms: int = 600_000,
) -> DataFrame:
    """Admit the first ``limit`` calls of a key and minute in order of arrival: rate_key, ts, seq, admitted.

    The state of a key and minute is the number of calls admitted so far. Within a batch at most ``limit`` calls are
    held back while a group is read in chunks, so a busy key needs no more memory than others. Every call gets a verdict,
    late ones too: the watermark follows the time of arrival, and state goes when its key and minute had no call for ``keep_ms``
    of clock time. Minutes are whole numbers, so that the session's time zone has no part in them.
    """

    def decide(
        group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        room = max(0, limit - used)
        first = None
        for chunk in chunks:
            pool = chunk if first is None else pd.concat([first, chunk], ignore_index=True)
            pool = pool.sort_values(["ts", "seq"], kind="stable")
            first = pool.iloc[:room]
            if len(pool) > room:
                yield pool.iloc[room:][["rate_key", "ts", "seq"]].assign(admitted=False)
        if first is not None and len(first):
            yield first[["rate_key", "ts", "seq"]].assign(admitted=True)
            used += len(first)
        state.update((used,))
        state.setTimeoutTimestamp(max(int(time.time() * 1000), state.getCurrentWatermarkMs()) + keep_ms)

    rows = calls.select(
        F.col(key).alias("rate_key"),
        F.col(ts).alias("ts"),
        F.col(seq).cast("bigint").alias("seq"),
        F.current_timestamp().alias("arrived"),
    ).withWatermark("arrived", "1 minute")
    return (
        rows.withColumn("minute", F.floor(F.unix_seconds("ts") / 60))
        .groupBy("rate_key", "minute")
        .applyInPandasWithState(
            decide,
            "rate_key string, ts timestamp, seq bigint, admitted boolean",
            "used int",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


USED = "rate_key string, minute bigint, n bigint, last struct<ts:timestamp,seq:bigint>, hour bigint, batch bigint"


def write_admitted(
    calls: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "rate_key",
    ts: str = "ts",
    seq: str = "seq",
    limit: int = fv.CALLS_PER_MINUTE,
    trigger: dict = DRAIN,
) -> StreamingQuery:
    """Admit the first ``limit`` calls of a key and minute, batch by batch: rate_key, ts, seq, admitted below ``path``/verdicts.

    Earlier batches come first, then time and number. The state is a table: how many calls each batch admitted, by hour. Of a busy key,
    each partition sends ``limit`` calls a minute to the shuffle that looks for the last admitted one; all calls are then
    compared with it. A repeated batch sees the same earlier batches and overwrites what it wrote. Folders of hours that get no more calls
    may be removed. Calls without key or time are admitted and not counted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(key).alias("rate_key"), F.col(ts).alias("ts"), F.col(seq).cast("bigint").alias("seq"))
        minutes = rows.withColumn("minute", F.floor(F.unix_seconds("ts") / 60))
        order = Window.partitionBy("rate_key", "minute").orderBy("ts", "seq")
        countable = F.col("rate_key").isNotNull() & F.col("minute").isNotNull()
        firsts = minutes.where(countable).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
        firsts = firsts.withColumn("hour", F.floor(F.col("minute") / 60))
        room = F.lit(limit)
        if batch_id:
            earlier = spark.read.schema(USED).parquet(f"{path}/used").where(F.col("batch") < batch_id)
            used = earlier.groupBy("rate_key", "minute", "hour").agg(F.sum("n").alias("_used"))
            firsts = firsts.join(used, ["rate_key", "minute", "hour"], "left")
            room = limit - F.coalesce("_used", F.lit(0))
        admitted = firsts.where(F.col("_n") <= room).groupBy("rate_key", "minute", "hour").agg(
            F.count("*").alias("n"), F.max(F.struct("ts", "seq")).alias("last")
        )
        stored = admitted.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        stored.option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(f"{path}/used")
        # every key and minute with room has an admitted call; one that isn't listed has none
        last = spark.read.schema(USED).parquet(f"{path}/used").where(F.col("batch") == batch_id).select("rate_key", "minute", "last")
        within = F.coalesce(F.struct("ts", "seq") <= F.col("last"), F.lit(False))
        verdicts = minutes.join(last, ["rate_key", "minute"], "left").select(
            "rate_key", "ts", "seq", F.when(countable, within).otherwise(True).alias("admitted")
        )
        verdicts.write.mode("overwrite").parquet(f"{path}/verdicts/batch={batch_id}")

    return _each_batch(calls, write, checkpoint, trigger)


def write_all_sinks(
    texts: DataFrame, path: str, vault: str, checkpoint: str, text: str = "text", key: str = "scan_id",
    options: ScanOptions = ScanOptions(), trigger: dict = DRAIN,
) -> StreamingQuery:
    """Findings, masked texts and summaries below ``path`` and the vault below ``vault``, from one scan of each batch. The vault
    holds what was masked and belongs to a place of its own.

    Every batch has a folder of its own that a repeated batch overwrites, so each text counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scanned = scan_texts(spread(batch), text, options).persist()
        types = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["pii_type"])))
        placeholders = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["placeholder"])))
        try:
            outputs = {
                f"{path}/findings": explode_findings(scanned, key).drop("text"),
                f"{path}/redacted": scanned.select(key, "anonymised_text"),
                f"{path}/summary": scanned.select(
                    key,
                    F.size("findings").cast("bigint").alias("pii_found"),
                    types.alias("pii_types"),
                    placeholders.alias("placeholders"),
                ),
                vault: placeholder_map(scanned, key),
            }
            for folder, rows in outputs.items():
                rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        finally:
            scanned.unpersist()

    return _each_batch(texts, write, checkpoint, trigger)
