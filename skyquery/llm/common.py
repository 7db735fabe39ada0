"""Shared pieces: cutting lineage in the shared folder, word tables, blocks and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds as words at a time.
SLICE_BYTES = 2 << 20
#: Rows and megabytes of a batch that goes to or from a Python worker.
BATCH_ROWS, BATCH_MB = 1500, 8
#: Distinct words that a worker remembers before it starts its table anew.
WORD_LIMIT = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only on a single machine a temporary one will do where none is set; elsewhere that raises ValueError."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors could not share what is written")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skyquery-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


#: The session setting with which Spark drops an execution's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it an execution's shuffle files are dropped at its end: for plans whose rows are written and read from there only."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, with no lineage behind them."""
    shared_dir(df.sparkSession)
    with _shuffles_end(df.sparkSession):
        # a plan of its own, made under the setting
        return df.select("*").checkpoint(eager=True)


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` within it are deleted at its end: for results that are written inside."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, *, outlives: bool = False) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: columnar, so later readers can prune. The ``scope`` it is made in deletes it, unless it ``outlives`` that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skyquery/{name}-{uuid.uuid4().hex}"
    if _scopes and not outlives:
        _scopes[-1].append(path)
    with _shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare_name(columns: list[str], name: str = "_text") -> str:
    """A name that none of the columns has."""
    while name in columns:
        name += "_"
    return name


def mapped(df: DataFrame, task, schema) -> DataFrame:
    """``mapInArrow`` in batches of a few megabytes, as texts need: with the default number of rows two tasks' batches alone fill an executor.

    It lowers the session's Arrow batch settings, which are read when a plan runs, and so cannot be set for it alone. Names
    with a dot, which ``mapInArrow`` does not take, reach the task with another character in its place.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_MB}m")
    if any("." in c for c in df.columns):
        df = df.toDF(*[c.replace(".", "\u2024") for c in df.columns])
    return df.mapInArrow(task, schema)


def dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of equal key together, in key order, in as many partitions as shuffles have: what is done with them costs more than their bytes tell."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order)


def held_out(doc_id: Column | str) -> Column:
    """True for the documents that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_share(column: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the value: the base of samples that do not depend on partitioning."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


class WordTable:
    """Numbers the distinct words that a worker meets, so that what a word needs is worked out once.

    ``ids`` splits texts at ASCII white space and returns the words' numbers. Words from
    ``ready`` on are new since the caller last called ``take_fresh``. The table is emptied
    between slices once it holds more than ``limit`` words, so its size is bounded.
    """

    def __init__(self, limit: int = WORD_LIMIT):
        self.limit = limit
        self.resets = 0
        self.clear()

    def clear(self) -> None:
        words: list[bytes] = []

        class Numbers(dict):
            def __missing__(self, word):
                self[word] = n = len(words)
                words.append(word)
                return n

        self.words, self.number, self.ready = words, Numbers(), 0

    def ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, one after another, and how many each text has."""
        if len(self.words) > self.limit:
            self.clear()
            self.resets += 1
        get, parts = self.number.__getitem__, []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = text.split()
                counts[i] = len(found)
                parts.append(np.fromiter(map(get, found), np.int32, len(found)))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts

    def take_fresh(self) -> list[bytes]:
        fresh, self.ready = self.words[self.ready :], len(self.words)
        return fresh


class Grown:
    """An array with a row for each word of a WordTable, grown as new words come."""

    def __init__(self, dtype, width: int = 0):
        self.shape = (lambda n: (n, width)) if width else (lambda n: (n,))
        self.data, self.size = np.zeros(self.shape(1024), dtype), 0

    def clear(self) -> None:
        self.size = 0

    def extend(self, rows: np.ndarray) -> None:
        end = self.size + len(rows)
        if end > len(self.data):
            grown = np.zeros(self.shape(max(end, 2 * len(self.data))), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : end] = rows
        self.size = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


class HashedWords:
    """Texts to the 64-bit hashes of their words."""

    def __init__(self):
        self.table, self.hashes, self.resets = WordTable(), Grown(np.uint64), 0

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.table.ids(texts)
        if self.table.resets != self.resets:
            self.hashes.clear()
            self.resets = self.table.resets
        self.hashes.extend(word_hashes(self.table.take_fresh()))
        return self.hashes.data[ids], counts


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of the batches whose texts have about ``most`` bytes together, with the texts as bytes. A longer text is a part of its own."""
    for batch in batches:
        texts = batch.column(column)
        if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_binary())
        sizes = np.asarray(texts.is_null().to_numpy(zero_copy_only=False))
        lengths = np.zeros(len(texts), np.int64)
        lengths[~sizes] = pc.binary_length(texts.drop_null()).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and (total + n > most or i - begin >= 4096):
                yield batch.slice(begin, i - begin), texts.slice(begin, i - begin).to_pylist()
                begin, total = i, 0
            total += n
        if len(lengths) > begin:
            yield batch.slice(begin), texts.slice(begin).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows of equal key from batches that are sorted by it, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(keys)]
        for s, e in zip(starts, ends, strict=True):
            if held and keys[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = keys[s]
    if held:
        yield pa.Table.from_batches(held)


def block_rows(members: DataFrame, keys: list[str], size: str, member: str, chunk: int) -> DataFrame:
    """Splits each group into chunks and deals every pair of chunks to a block of its own.

    A group of ``size`` rows becomes ceil(size / chunk) chunks; each row goes to one block
    for each chunk of its group, so that any two rows meet in exactly one block, and no
    block holds more than about two chunks whatever the size of the group. Adds ``blk``
    (the block), ``side`` (0 or 1, the chunk within the block) and ``alone`` (the group is
    a single block).
    """
    n = F.ceil(F.col(size) / F.lit(chunk)).cast("int")
    dealt = members.withColumn("_n", n).withColumn("_c", F.pmod(F.xxhash64(F.col(member), F.lit(77)), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("_c", "_o"), F.greatest("_c", "_o")
    return dealt.select(
        *members.columns,
        F.xxhash64(*keys, low, high).alias("blk"),
        F.when(low == high, 0).when(F.col("_c") == low, 0).otherwise(1).cast("int").alias("side"),
        (low == high).alias("same"),
        (F.col("_n") == 1).alias("alone"),
    )


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n things the smallest number that it is linked with, by whatever way."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """(node, root): each node of the edges (u, v) with the smallest node of its component.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join;
    what is left after every round is cut to the shared folder. A node with very many
    neighbours is a hot join key, which adaptive execution splits; minima are
    aggregated before the shuffle. The rounds needed grow with the logarithm of the longest
    chain; edges that have not settled after ``rounds`` raise RuntimeError.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _state(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: a join straight on shuffles is one whose hot keys can be split
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
