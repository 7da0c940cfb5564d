"""White lists as tables: tokens are found in texts by an index of short pieces instead of by an array in every row.

Each token is filed under one of its pieces, the one that fewest tokens have: of four characters at first, and of twice as many as long as
more than CROWD tokens have that piece; shorter tokens under themselves. A text that contains the token has that piece, so that an
equi-join by piece finds every pair, and a look into the text decides. Longer lists have longer pieces, so that a piece of a text meets few
tokens however many there are. The join is never a nested loop, and no list is as long as a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions.arrays import bind, empty_array
from redactlake.functions.spans import FINDING, assign_placeholders, clean_tokens, mask, resolve_overlaps
from redactlake.sources import sinks

#: Characters of a piece, and how many tokens may have a piece before longer ones are tried.
PIECES, CROWD = (4, 8, 16, 32, 64), 16


def _pieces(text: Column, length: int) -> Column:
    """The different pieces of ``length`` characters of a text."""
    last = F.char_length(text) - length + 1
    whole = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(length)))
    return F.when(last >= 1, F.array_distinct(whole)).otherwise(empty_array("string"))


def token_index(tokens: DataFrame) -> DataFrame:
    """piece, token of a table with a column token: cleaned (trimmed, lower case, no blank ones), each token once. Written to the shared folder,
    one table for each length of pieces that is needed."""
    cleaned = tokens.select(F.explode(clean_tokens(F.array(F.col("token").cast("string")))).alias("token")).distinct()
    spark, path = tokens.sparkSession, sinks.shared_dir(tokens.sparkSession, "token-index")
    left, settled = cleaned, []
    for length in PIECES:
        pieces = F.when(F.char_length("token") < length, F.array("token")).otherwise(_pieces(F.col("token"), length))
        filed = left.select("token", F.explode(pieces).alias("piece"))
        shared = filed.groupBy("piece").agg(F.count("*").alias("tokens"))
        rarest = F.min(F.struct("tokens", "piece")).alias("rarest")
        best = filed.join(shared, "piece").groupBy("token").agg(rarest).select("token", "rarest.*")
        best.write.parquet(f"{path}/{length}")
        best = spark.read.schema(best.schema).parquet(f"{path}/{length}")
        crowded = (F.col("tokens") > CROWD) & (F.char_length("token") > length)
        left = best.where(crowded).select("token")
        if length == PIECES[-1] or left.isEmpty():
            settled.append(best)
            break
        settled.append(best.where(~crowded))
    return reduce(DataFrame.unionByName, settled).select("piece", "token")


def containing(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """The texts (one column ``low``, in lower case) that contain a token of the table ``tokens`` (token), each once.

    Rows that are joined carry hashes in place of the text and its pieces, so that long texts cost in proportion to their length. Different texts
    or pieces of one hash are more pairs to look at, and the look into the text decides.
    """
    index = token_index(tokens)
    # at most as many different lengths as the longest pieces that are needed have characters
    lengths = sorted(r.n for r in index.select(F.char_length("piece").alias("n")).distinct().collect())
    if not lengths:
        return texts.where(F.lit(False))
    named = texts.distinct().withColumn("digest", F.xxhash64("low"))
    pieces = F.concat(*[_pieces(F.col("low"), n) for n in lengths])
    of_texts = named.select("digest", F.explode(pieces).alias("piece")).select("digest", F.xxhash64("piece").alias("piece"))
    pairs = of_texts.join(index.select(F.xxhash64("piece").alias("piece"), "token"), "piece").select("digest", "token")
    return named.join(pairs, "digest").where(F.contains("low", F.col("token"))).select("low").distinct()


def scan_with_tokens(found: DataFrame, tokens: DataFrame, key: str = "scan_id", text: str = "text") -> DataFrame:
    """Masked texts with ``findings`` and ``anonymised_text``, as ``scan_texts`` gives them for a white list in the row.

    ``found``: a key that no two rows share, the text, and ``candidates`` (``column_candidates``). It is read several times:
    write it first. Tokens are compared with each different candidate text once; texts without candidates are not shuffled.
    """
    low = F.lower("candidate.text").alias("low")
    some = found.where(F.size("candidates") > 0)
    placed = some.select(key, F.posexplode("candidates").alias("place", "candidate")).select(key, "place", low)
    allowed = containing(placed.select("low"), tokens)
    dropped = placed.join(allowed, "low").groupBy(key).agg(F.collect_list("place").alias("_dropped"))

    def left(candidates: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(candidates) - 1), F.coalesce("_dropped", empty_array("int")))
        return F.transform(places, lambda i: F.get(candidates, i))

    settled = bind(left(F.col("candidates")), lambda k: F.when(F.size(k) > 0, assign_placeholders(resolve_overlaps(k))))
    scanned = some.join(dropped, key, "left").withColumn("findings", F.coalesce(settled, empty_array(FINDING)))
    rest = found.where(F.coalesce(F.size("candidates"), F.lit(0)) <= 0).withColumn("findings", empty_array(FINDING))
    both = scanned.drop("_dropped", "candidates").unionByName(rest.drop("candidates"))
    return both.withColumn("anonymised_text", mask(F.col(text), F.col("findings")))
