"""Helpers that several corpus operators share: the shared folder, written
intermediate tables, sized broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; larger ones are shuffle-joined.
BROADCAST_ROWS = 50_000
#: Edges of one node above which its least neighbour is broadcast to them instead of joined.
HUB = 512
#: Bytes, at most, of an Arrow batch on its way to a Python worker. Spark's own limit is 64 MB: a task's texts are mostly one batch, which
#: its executor holds in vectors that grow by doubling and its worker holds again.
BATCH_BYTES = 4 << 20
#: Stands for a null in internal join keys.
NULL_KEY = "\x00null"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` names it. Only where it is unset and
    the master is local a temporary folder is made and set; a cluster without
    the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='latentspark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    Cuts the lineage with files that outlive any executor."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``limit`` rows; else as it
    is, so that the join shuffles and the adaptive planner splits hot keys.

    ``df`` should be a written table: its rows are counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def keyed(column: str | Column) -> Column:
    """A string join key in which nulls equal each other."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(NULL_KEY))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` doesn't have in any case."""
    taken, tail = {c.lower() for c in df.columns}, "_"
    while any(f"x_{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"x_{n}{tail}" for n in names]


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, for a function over Arrow batches of texts: the session sends at most ``BATCH_BYTES`` of rows at once from here on.

    A limit that the session sets itself stays. A single row is never cut."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, str(BATCH_BYTES))
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _met(edges: DataFrame, least: DataFrame, has_hubs: bool) -> DataFrame:
    """``edges`` (x, y) with the ``m`` of their ``x``; with hubs, ``least`` (x, m, n) is a written table."""
    if not has_hubs:
        return edges.join(least.drop("n"), "x")
    hubs = sized_broadcast(least.where(F.col("n") > HUB).select("x", "m"))
    return edges.join(hubs, "x").unionByName(edges.join(hubs, "x", "left_anti").join(least.where(F.col("n") <= HUB).drop("n"), "x"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating stars.

    ``edges`` has columns ``a``, ``b`` (long). Returns (node, root) for every
    node that has an edge to another one; ``root`` is the least node of its
    component. Large-star and small-star rounds (Kiveris et al., 2014) turn
    the graph into stars in O(log^2 n) rounds. Minima come from partially
    aggregated groups; those of nodes with over ``HUB`` edges, of which there
    are few, are broadcast to the edges, so no task gathers a hub's edges.
    No edges give no rows; self-loops, repeated edges and nulls are ignored.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first())

    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(),
        "edges",
    )
    before = state(e)
    if before[0] == 0:
        return spark.createDataFrame([], "node long, root long")
    for _ in range(max_rounds):
        both = e.select("x", "y").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        top = both.groupBy("x").count().agg(F.max("count")).first()[0]
        table = written if top > HUB else lambda df, name: df
        least = table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n")), "least")
        large = table(_met(both.where("y > x"), least, top > HUB).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "large")
        parent = table(large.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")), "parents")
        small = (
            _met(large, parent, top > HUB).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
            .unionByName(parent.select("x", F.col("m").alias("y")))
            .distinct()
        )
        done = written(small, "edges")
        after = state(done)
        drop_written(e)
        e = done
        if after == before:
            return e.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
