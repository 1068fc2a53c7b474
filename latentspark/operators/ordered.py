"""Ordered computations of long series without a task per series.

Rows get their position in their series from a sort by range; with positions,
windows of bounded length run over chunks with copied border rows, running totals
over chunks with carried totals, and as-of joins over time buckets with a
carried row. A task holds a chunk or a bucket, whatever the series' length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from latentspark.sources.scratch import sized, written

#: Rows of a range partition, and positions of a chunk.
ROWS = 100_000

_AGGREGATES = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min, "count": F.count}


def tasks_for(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined on ``keys``, nulls equal; ``right``'s own names of them must begin with ``of_``."""
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys), F.lit(True))
    return left.join(right, on, how).drop(*(f"of_{k}" for k in keys))


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"of_{k}" for k in keys})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "t", rows: int = ROWS) -> DataFrame:
    """Adds ``out``: the row's position from 0 among the rows of its key in ``order`` (nulls first).

    Rows are dealt and sorted by range of (keys, order) and written with a running
    number; a row a partition and key says at which position its run begins. One sort of the data
    and no window over a key. Rows that tie in ``order`` get one of the orders, the same on every reading. Null keys are a
    key of their own. The names ``row_at``, ``row_part`` and ``of_`` before a key are used inside."""
    dealt = df.repartitionByRange(tasks_for(df, rows), *keys, *order).sortWithinPartitions(*keys, *order)
    at = written(dealt.withColumn("row_at", F.monotonically_increasing_id()), "numbered").withColumn("row_part", F.shiftright("row_at", 33))
    runs = written(at.groupBy(*keys, "row_part").agg(F.min("row_at").alias("run_at"), F.count("*").alias("run_n")), "runs")
    before = Window.partitionBy(*keys).orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("run_start", F.coalesce(F.sum("run_n").over(before), F.lit(0))).drop("run_n")
    begun = sized(written(_renamed(starts, [*keys, "row_part"]), "run-starts"))
    return _same(at, begun, [*keys, "row_part"]).withColumn(out, F.col("row_at") - F.col("run_at") + F.col("run_start")).drop("row_at", "row_part", "run_at", "run_start")


def _chunk(t: str, rows: int) -> Column:
    return F.floor(F.col(t) / rows)


def trailing(df: DataFrame, keys: Sequence[str], t: str, before: int, columns: dict[str, Callable[[WindowSpec], Column]], rows: int = ROWS) -> DataFrame:
    """Adds ``columns``, each made of a window that reaches from at most ``before`` rows back to the row.

    ``t`` is the dense position of :func:`numbered`. A chunk of ``rows`` positions is a window of its own, which also holds
    copies of the ``before`` rows in front of it. Null keys are a key of their own; the name ``row_chunk`` is used inside."""
    rows = max(rows, before, 1)
    here = _chunk(t, rows)
    copies = F.when(F.pmod(F.col(t), F.lit(rows)) >= rows - before, F.array(here, here + 1)).otherwise(F.array(here))
    dealt = df.withColumn("row_chunk", F.explode(copies))
    w = Window.partitionBy(*keys, "row_chunk").orderBy(t)
    return dealt.withColumns({name: f(w) for name, f in columns.items()}).where(F.col("row_chunk") == here).drop("row_chunk")


def running(df: DataFrame, keys: Sequence[str], t: str, columns: dict[str, tuple[str, Column]], rows: int = ROWS) -> DataFrame:
    """Adds running ``columns``, each a kind (sum, product, max, min or count) of an expression, over all rows of the key up to the row.

    Totals of chunks of ``rows`` positions are carried to later chunks; a chunk's own rows are one window. Nulls are
    skipped; null while there was none but nulls. ``t`` is the dense position of :func:`numbered`. ``row_chunk`` and
    names that end in ``_carried`` are used inside."""
    dealt = df.withColumn("row_chunk", _chunk(t, rows))
    totals = written(dealt.groupBy(*keys, "row_chunk").agg(*(_AGGREGATES[kind](x).alias(name) for name, (kind, x) in columns.items())), "chunk-totals")
    earlier = Window.partitionBy(*keys).orderBy("row_chunk").rowsBetween(Window.unboundedPreceding, -1)
    over_totals = {name: _AGGREGATES["sum" if kind == "count" else kind](F.col(name)).over(earlier).alias(f"{name}_carried") for name, (kind, _) in columns.items()}
    carried = sized(written(_renamed(totals.select(*keys, "row_chunk", *over_totals.values()), [*keys, "row_chunk"]), "carried"))
    inside = Window.partitionBy(*keys, "row_chunk").orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = _same(dealt.withColumns({name: _AGGREGATES[kind](x).over(inside) for name, (kind, x) in columns.items()}), carried, [*keys, "row_chunk"])
    put = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "product": lambda a, b: a * b, "max": F.greatest, "min": F.least}

    def joined(name: str, kind: str) -> Column:
        before, own = F.col(f"{name}_carried"), F.col(name)
        return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(put[kind](before, own))

    return got.withColumns({name: joined(name, kind) for name, (kind, _) in columns.items()}).drop("row_chunk", *(f"{n}_carried" for n in columns))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Adds ``before_<column>``: the sum of ``column`` over the key's rows that come before in ``order``, which should not tie.

    Rows are dealt by range; a partition's sums are carried to those after it."""
    dealt = written(df.repartitionByRange(tasks_for(df, rows), *keys, *order).withColumn("row_part", F.spark_partition_id()), "ranged")
    totals = written(dealt.groupBy(*keys, "row_part").agg(*(F.sum(c).alias(c) for c in columns)), "range-totals")
    earlier = Window.partitionBy(*keys).orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sized(written(_renamed(totals.select(*keys, "row_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_carried") for c in columns)), [*keys, "row_part"]), "carried"))
    inside = Window.partitionBy(*keys, "row_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return _same(local, carried, [*keys, "row_part"]).withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"{c}_carried") for c in columns}).drop("row_part", *(f"{c}_carried" for c in columns))


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], bucket: Callable[[Column], Column], inclusive: bool = True, not_before: Column | None = None
) -> DataFrame:
    """Every row of ``left`` with ``columns`` and ``right_time`` of the last row of ``right`` that has its keys and isn't later (without ``inclusive``: is earlier).

    ``bucket`` maps a time to a whole number that never falls; a task holds a key's rows of one
    bucket, and the last row before it is carried there through a table of a row per key and bucket. Rows of ``right`` with one time: the largest
    in ``columns``. Nothing matches null keys or times; such rows of ``left`` stay, with nulls. Matches earlier than
    ``not_before``, a column of ``left``, don't count. Names that begin with ``as_of_`` are used inside."""
    names = [right_time, *columns]
    found = right.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, right_time))))
    found = found.select(*keys, F.col(right_time).alias("as_of_time"), F.struct(*names).alias("as_of_row")).withColumn("as_of_bucket", bucket(F.col("as_of_time")))
    rows = left.withColumn("as_of_time", F.col(left_time)).withColumn("as_of_bucket", bucket(F.col("as_of_time")))
    latest = found.groupBy(*keys, "as_of_bucket").agg(F.max(F.struct("as_of_time", "as_of_row")).alias("as_of_last"))
    asked = rows.select(*keys, "as_of_bucket").where("as_of_bucket is not null").distinct().withColumn("as_of_last", F.lit(None).cast(latest.schema["as_of_last"].dataType))
    per_bucket = latest.unionByName(asked).groupBy(*keys, "as_of_bucket").agg(F.max("as_of_last").alias("as_of_last"))
    earlier = Window.partitionBy(*keys).orderBy("as_of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.withColumn("as_of_row", F.last("as_of_last", ignorenulls=True).over(earlier)["as_of_row"]).where("as_of_row is not null").select(*keys, "as_of_bucket", "as_of_row")
    # Carried rows come first in a bucket; on equal times right rows stand before or after left ones.
    packed = F.struct(*(F.col(c) for c in left.columns))
    side = rows.select(*keys, "as_of_bucket", "as_of_time", F.lit(1).alias("as_of_turn"), F.lit(None).cast(found.schema["as_of_row"].dataType).alias("as_of_row"), packed.alias("as_of_left"))
    none = F.lit(None).cast(side.schema["as_of_left"].dataType).alias("as_of_left")
    new = found.select(*keys, "as_of_bucket", "as_of_time", F.lit(0 if inclusive else 2).alias("as_of_turn"), "as_of_row", none)
    old = carried.select(*keys, "as_of_bucket", F.lit(None).cast(found.schema["as_of_time"].dataType).alias("as_of_time"), F.lit(-1).alias("as_of_turn"), "as_of_row", none)
    w = Window.partitionBy(*keys, "as_of_bucket").orderBy(F.col("as_of_time").asc_nulls_first(), "as_of_turn", "as_of_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, "as_of_bucket")))
    met = side.where(usable).unionByName(new).unionByName(old).withColumn("as_of_row", F.last("as_of_row", ignorenulls=True).over(w)).where("as_of_left is not null")
    out = met.unionByName(side.where(~usable)).select("as_of_left.*", *(F.col("as_of_row")[c].alias(c) for c in names))
    if not_before is None:
        return out
    stands = F.coalesce(F.col(right_time) >= not_before, F.lit(False))
    return out.withColumns({c: F.when(stands, F.col(c)) for c in columns} | {right_time: F.when(stands, F.col(right_time))})
