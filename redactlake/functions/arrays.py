"""Small building blocks for array expressions that stay linear in the array length."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
_KEPT = 200


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``; lambdas would re-evaluate it per element.

    A fold over nothing, of which ``body`` is the last step: taking the result out of an array instead would make Spark work out the
    type of the whole of ``body`` for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression that ``build`` returns for the same (hashable) arguments. Putting together a whole scan
    takes thousands of calls into the JVM; expressions are immutable, so plans can share them. The last _KEPT are kept."""
    kept: dict[tuple, Column] = {}

    @wraps(build)
    def get(*args) -> Column:
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in kept:
            if len(kept) >= _KEPT:
                del kept[next(iter(kept))]
            kept[key] = build(*args)
        return kept[key]

    return get


def empty_array(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def fold_collect(
    items: Column,
    state: dict[str, Column],
    step: Callable[[Column, Column], tuple[dict[str, Column], Column]],
    ddl: str,
    finish: Callable[[Column, Column], Column] = lambda collected, _: collected,
) -> Column:
    """Run over ``items`` from left to right with a state and collect what ``step`` emits.

    ``step(state, item)`` returns the next state and the emitted value, or NULL to emit nothing. Emitted values go
    to a block of fixed size first, so that appending does not copy everything collected so far.
    ``finish(collected, state)`` may use the last state.
    """
    zero = F.struct(
        *[value.alias(name) for name, value in state.items()],
        empty_array(f"array<{ddl}>").alias("blocks"),
        empty_array(ddl).alias("block"),
    )

    def merge(acc: Column, item: Column) -> Column:
        following, emitted = step(acc, item)
        one = F.array(emitted.cast(ddl))
        full = F.size(acc["block"]) >= _BLOCK
        keep = emitted.isNull()
        return F.struct(
            *[following[name].alias(name) for name in state],
            F.when(full & ~keep, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(keep, acc["block"]).when(full, one).otherwise(F.concat(acc["block"], one)).alias("block"),
        )

    def close(acc: Column) -> Column:
        return finish(F.flatten(F.concat(acc["blocks"], F.array(acc["block"]))), acc)

    return F.aggregate(items, zero, merge, close)
