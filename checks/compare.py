"""Run registered queries and their SQL side by side and report differences.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracle
from redactlake.plans import queries as registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SAME_TYPE = {"varchar": "string", "integer": "int"}


def local_session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    begun = time.time()
    df = registered.queries()[name](spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    spark_done = time.time()
    result = con.execute(oracle.queries()[name])
    columns = [c[0] for c in result.description]
    theirs = canonical(columns, result.fetchall())
    took = f"{len(mine)} rows, {spark_done - begun:.1f} s, SQL {time.time() - spark_done:.1f} s"
    if sorted(columns) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} / {sorted(columns)}"
    mine_types = {c: t for c, t in df.dtypes}
    their_types = {c[0]: SAME_TYPE.get(str(c[1]).lower(), str(c[1]).lower()) for c in result.description}
    odd = {c: (t, their_types[c]) for c, t in mine_types.items() if t != their_types[c]}
    if odd:
        took += f", types {odd}"
    if mine == theirs:
        return f"same ({took})"
    left, right = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
    return f"DIFF ({took}, SQL {len(theirs)} rows)\n   spark {left}\n   sql   {right}"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or list(registered.queries()):
        try:
            print(name, compare(spark, con, sf_dir, name), flush=True)
        except Exception as error:  # report and go on with the next query
            print(name, "FAILED", str(error).strip()[:400], flush=True)


if __name__ == "__main__":
    main()
