"""Leaving out rows that a join would drop, before their texts are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.store import free_name

#: Bits of a filter per id, and at most: 2**26 bits are 8 MB, whatever the number of ids. Beyond it lets more rows through.
BITS_PER_ID, MOST_BITS = 16, 1 << 26


def likely_members(rows: DataFrame, key: str, ids: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose `key` (bigint) is in `ids` (one column, bigint), and a few others; the join that follows decides. With
    `others`, the remaining rows with a key, none of which is in `ids`.

    A bit is set for the hash of each id. Only the words of the bitmap come to the driver, MOST_BITS bits in all.
    """
    (name,) = ids.columns
    place_name = free_name(rows, "_place")
    wanted = max(64, min(MOST_BITS, BITS_PER_ID * max(1, ids.count())))
    bits = 1 << (wanted - 1).bit_length()
    place = F.pmod(F.xxhash64(name), F.lit(bits))
    words = ids.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{name}`), 64) as int))").alias("bit"))
    bitmap = np.zeros(bits // 64, np.int64)
    known = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap[known.column("word").to_numpy()] = known.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at = batch.column(place_name).to_numpy()
            kept = ((own[at >> 6] >> (at & 63)) & 1 == 1) != others
            yield batch.filter(pa.array(kept)).select([n for n in batch.schema.names if n != place_name])

    hashed = rows.where(F.col(key).isNotNull()).withColumn(place_name, F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(bits)))
    return hashed.mapInArrow(members, rows.schema)
