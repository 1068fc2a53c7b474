"""A content-addressed store of token ids.

Files under one folder:

* ``chunks``: (chunk, n, ids): runs of ids, each stored once, named by the
  BLAKE2b-128 of their bytes. Ids are little-endian, 16 bits wide where the
  vocabulary allows it, else 32.
* ``documents``: (i, doc_id, start, n_tokens, chunks, sizes) in ascending doc_id
  order: the recipe of each document and its place in the id stream.
* ``manifest``: (level, i, hash): a Merkle tree over the recipes, 256 children to a node.

A rolling hash over the last 16 ids places the cuts, so equal passages are cut
alike wherever they stand, and only the chunks around a change differ.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentspark.llm.common import drop_written, new_table_path, sized_broadcast, written
from latentspark.llm.tokens import encoder

WINDOW, LEAST, MASK, MOST = 16, 64, 0x1FF, 8192
FAN_OUT = 256
#: Duplicate chunks (24 bytes each) up to which their owners are broadcast.
OWNERS_BROADCAST = 400_000
#: Chunk names that a task remembers as already emitted; copies beyond them are emitted again and dropped by ``_write_chunks``.
REMEMBERED = 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Polynomial hash of the ``WINDOW`` ids that end at each place, by doubling."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * _MUL
        h ^= h >> np.uint64(29)
        width, factor = 1, _BASE
        while width < WINDOW:
            longer = h.copy()
            longer[width:] += factor * h[:-width]
            h, width, factor = longer, width * 2, factor * factor
        return h >> np.uint64(32)


def cuts(marks: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of ``n`` ids: marked places at least ``LEAST`` after the last cut; after ``MOST`` ids without one, there."""
    ends, last = [], 0
    for m in marks.tolist():
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST and n - m >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def _stage_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int, remembered: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, doc_id, row, chunk, n, ids, chunks, sizes): a recipe per document, and each chunk's bytes, numbered in the task, once as far as the task remembers."""
    ids_of, part = encoder(path).ids, TaskContext.get().partitionId()
    emitted: set[bytes] = set()
    row = piece_row = 0
    schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("chunk", pa.binary()), ("n", pa.int32()), ("ids", pa.binary()), ("chunks", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))])
    for b in batches:
        docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for at in range(0, len(texts), 500):
            recipes, chunks = [], []
            for doc, text in zip(docs[at : at + 500], texts[at : at + 500], strict=True):
                ids = np.append(ids_of(text), np.uint32(end_id))
                marks = np.flatnonzero((rolling_hash(ids)[WINDOW - 1 :] & np.uint64(MASK)) == 0) + WINDOW if len(ids) >= 2 * LEAST else np.empty(0, np.int64)
                data, start, names, sizes = ids.astype(f"<u{width}").tobytes(), 0, [], []
                for end in cuts(marks, len(ids)):
                    piece = data[start * width : end * width]
                    name = hashlib.blake2b(piece, digest_size=16).digest()
                    names.append(name)
                    sizes.append(end - start)
                    if name not in emitted:
                        if len(emitted) < remembered:
                            emitted.add(name)
                        chunks.append((name, end - start, piece))
                    start = end
                recipes.append((doc, row, names, sizes))
                row += 1
            k, m = len(recipes), len(chunks)
            doc, rows, names, sizes = zip(*recipes, strict=True)
            name, n, piece = zip(*chunks, strict=True) if chunks else ((), (), ())
            no = lambda count: (None,) * count
            numbers = tuple(range(piece_row, piece_row + m))
            piece_row += m
            cols = [("d",) * k + ("c",) * m, doc + no(m), (part,) * (k + m), rows + numbers, no(k) + name, no(k) + n, no(k) + piece, names + no(m), sizes + no(m)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def write(docs: DataFrame, store: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id``, and writes the store.

    Null and empty texts are the end id alone; very long texts are encoded whole, as one recipe of many
    chunks. Rows with equal or null doc_ids, repeated ones too, are documents of
    their own, in the order in which they were read; null comes first. Other columns are ignored,
    whatever their names; no rows give a store without documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    remembered = REMEMBERED
    staged = rows.mapInArrow(
        lambda it: _stage_batches(it, path, end_id, width, remembered),
        "kind string, doc_id long, part int, row long, chunk binary, n int, ids binary, chunks array<binary>, sizes array<int>",
    )
    stage = new_table_path(spark, "token-stage")
    staged.write.partitionBy("kind").option("compression", "zstd").parquet(stage)
    read = lambda kind, columns: spark.read.schema(f"{columns}, kind string").parquet(stage).where(F.col("kind") == kind).drop("kind")
    _write_chunks(read("c", "part int, row long, chunk binary, n int, ids binary"), store)
    _write_recipes(read("d", "doc_id long, part int, row long, chunks array<binary>, sizes array<int>"), store)
    _write_manifest(spark, store)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(stage)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def _write_chunks(chunks: DataFrame, store: str) -> None:
    """Each chunk once: of a chunk that was emitted more than once, the least task's first copy stays. Only names are shuffled."""
    place = F.shiftleft(F.col("part").cast("long"), 40) + F.col("row")
    chunks = chunks.withColumn("place", place)
    owners = written(chunks.groupBy("chunk").agg(F.min("place").alias("owner"), F.count("*").alias("k")).where("k > 1").select(F.col("chunk").alias("dup"), "owner"), "owners")
    kept = chunks.join(sized_broadcast(owners, OWNERS_BROADCAST), F.col("chunk") == F.col("dup"), "left").where("dup is null or place = owner")
    kept.select("chunk", "n", "ids").write.option("compression", "zstd").parquet(f"{store}/chunks")
    drop_written(owners)


def _running_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds range, the partition, and each row's number and start of tokens in it."""
    part, at, start = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = start + np.cumsum(n)
        cols = [*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(at + np.arange(len(n))), pa.array(ends - n)]
        yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "range", "k", "local"])
        at, start = at + len(n), int(ends[-1]) if len(n) else start


def _write_recipes(recipes: DataFrame, store: str) -> None:
    """Files in ascending order of doc_id. Running starts are made inside range partitions, to which the totals of the ranges before are added."""
    order = [F.col("doc_id").asc_nulls_first(), "part", "row"]
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    ranged = recipes.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", total.alias("n_tokens"), "chunks", "sizes")
    placed = written(ranged.mapInArrow(_running_batches, "doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, range int, k long, local long"), "recipes")
    totals = placed.groupBy("range").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    before = Window.orderBy("range")  # a row per range partition
    offsets = totals.select("range", (F.sum("t").over(before) - F.col("t")).alias("t0"), (F.sum("n").over(before) - F.col("n")).alias("k0"))
    (
        placed.join(F.broadcast(offsets), "range")
        .select((F.col("k0") + F.col("k")).alias("i"), "doc_id", (F.col("t0") + F.col("local")).alias("start"), "n_tokens", "chunks", "sizes")
        .repartitionByRange("i").sortWithinPartitions("i")
        .write.parquet(f"{store}/documents")
    )
    drop_written(placed)


def _read_documents(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("i long, doc_id long, start long, n_tokens long, chunks array<binary>, sizes array<int>").parquet(f"{store}/documents")


def _leaves(documents: DataFrame) -> DataFrame:
    recipe = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", F.array_join(F.transform("chunks", F.hex), ","), F.array_join(F.col("sizes").cast("array<string>"), ","))
    return documents.select(F.lit(0).alias("level"), "i", F.sha2(recipe, 256).alias("hash"))


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("i", "hash")))  # FAN_OUT at most
    return (
        nodes.groupBy(F.expr(f"i div {FAN_OUT}").alias("p")).agg(ordered.alias("c"))
        .select(F.lit(level).alias("level"), F.col("p").alias("i"), F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ""), 256).alias("hash"))
    )


def _write_manifest(spark: SparkSession, store: str) -> None:
    level, nodes = 0, written(_leaves(_read_documents(spark, store)), "merkle")
    while True:
        nodes.write.mode("append").parquet(f"{store}/manifest")
        if nodes.count() <= 1:
            return
        level += 1
        nodes = written(_parents(nodes, level), "merkle")


def recipes_sound(spark: SparkSession, store: str) -> bool:
    """Whether the manifest is what the recipes give, level by level."""
    manifest = spark.read.schema("level int, i long, hash string").parquet(f"{store}/manifest")
    nodes, level = _leaves(_read_documents(spark, store)), 0
    top = manifest.agg(F.max("level")).first()[0] or 0
    while level <= top:
        said = manifest.where(F.col("level") == level).select("i", F.col("hash").alias("said"))
        wrong = said.join(nodes.select("i", "hash"), "i", "full").where("not (said <=> hash)")
        if not wrong.isEmpty():
            return False
        level, nodes = level + 1, _parents(said.withColumnRenamed("said", "hash"), level + 1)
    return manifest.where(F.col("level") == top).limit(2).count() <= 1


def verify(spark: SparkSession, store: str) -> bool:
    """Whether the manifest is what the recipes give, and every chunk has the hash it is named by."""
    return recipes_sound(spark, store) and _digests(spark, store).where("not sound").isEmpty()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc, sound = [], []
        for name, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            width = len(ids) // n
            sound.append(hashlib.blake2b(ids, digest_size=16).digest() == name and len(ids) == n * width)
            crc.append(zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], ["chunk", "n", "crc", "sound"])


def _digests(spark: SparkSession, store: str) -> DataFrame:
    """(chunk, n, crc, sound) of every stored chunk: how many ids it has, the CRC-32 of its ids at 32 bits, and whether its bytes have its name."""
    chunks = spark.read.schema("chunk binary, n int, ids binary").parquet(f"{store}/chunks")
    return chunks.mapInArrow(_digest_batches, "chunk binary, n int, crc long, sound boolean")


def _zeros_tables() -> list[np.ndarray]:
    """For each k, four tables of 256 that apply 2**k zero bytes to a CRC-32."""
    poly = np.uint32(0xEDB88320)
    def one(x: np.ndarray) -> np.ndarray:
        for _ in range(8):
            x = np.where(x & 1, (x >> np.uint32(1)) ^ poly, x >> np.uint32(1)).astype(np.uint32)
        return x
    byte = np.arange(256, dtype=np.uint32)
    tables = [np.stack([one(byte << np.uint32(8 * k)) for k in range(4)])]
    while len(tables) < 48:
        t = tables[-1]
        tables.append(np.stack([_through(t, t[k]) for k in range(4)]))
    return tables


def _through(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each part's CRC-32 contributes to the CRC of a whole in which ``after`` bytes follow; the whole's is the XOR of all."""
    crc = crc.astype(np.uint32)
    for k, t in enumerate(_TABLES):
        on = (after >> k & 1).astype(bool)
        if on.any():
            crc[on] = _through(t, crc[on])
    return crc


_TABLES = _zeros_tables()


def _shift_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc, after = (b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(shifted(crc, after).astype(np.int64))], ["i", "doc_id", "start", "n", "crc"])


def summary(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Each chunk is read and checked once; its CRC joins the recipes by name, and
    a document's CRC is the XOR of its chunks', each shifted by what follows,
    so that only names and numbers are shuffled. A chunk that is missing, has
    another number of ids than a recipe says or doesn't have the hash it is
    named by raises an error."""
    after = lambda k: F.aggregate(F.slice("sizes", k + 2, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x) * 4
    parts = _read_documents(spark, store).select("i", "doc_id", "start", F.posexplode(F.transform("chunks", lambda c, k: F.struct(c.alias("chunk"), F.get("sizes", k).cast("long").alias("n"), after(k).alias("after")))).alias("k", "c"))
    digests = _digests(spark, store).withColumn("crc", F.when(F.col("sound"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk's bytes differ from its name"))))
    joined = parts.select("i", "doc_id", "start", "c.n", "c.chunk", "c.after").join(digests.select("chunk", F.col("n").alias("stored"), "crc"), "chunk", "left")
    crc = F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long"))
    crc = F.when(F.col("stored").isNull() | (F.col("stored") == F.col("n")), crc).otherwise(F.raise_error(F.lit("a chunk's length differs from the recipe's")).cast("long"))
    moved = joined.select("i", "doc_id", "start", "n", crc.alias("crc"), "after").mapInArrow(_shift_batches, "i long, doc_id long, start long, n long, crc long")
    return moved.groupBy("i", "doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")).drop("i")


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """(i, doc_id, start, ids array<long>): the documents, put together again from their chunks."""
    chunks = spark.read.schema("chunk binary, n int, ids binary").parquet(f"{store}/chunks")
    parts = _read_documents(spark, store).select("i", "doc_id", "start", F.posexplode("chunks").alias("k", "chunk"))
    whole = parts.join(chunks, "chunk").groupBy("i", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("k", "n", "ids"))).alias("p"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = [np.concatenate([np.frombuffer(x["ids"], f"<u{len(x['ids']) // x['n']}").astype(np.int64) for x in p]) for p in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.list_(pa.int64()))], ["i", "doc_id", "start", "ids"])

    return whole.mapInArrow(batches, "i long, doc_id long, start long, ids array<long>")


def store_and_read(docs: DataFrame, path: str, end_id: int = 1, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`write`, then :func:`summary` of what was written, after the recipes
    have been checked against the manifest. Odd rows and other columns as in :func:`write`; no rows give no rows."""
    store = store or new_table_path(docs.sparkSession, "token-store")
    write(docs, store, path, end_id, id_col, text_col)
    return checked(docs.sparkSession, store)


def checked(spark: SparkSession, store: str) -> DataFrame:
    """:func:`summary`; recipes that aren't those of the manifest raise an error."""
    if not recipes_sound(spark, store):
        raise ValueError(f"{store}: the recipes differ from the manifest")
    return summary(spark, store)
