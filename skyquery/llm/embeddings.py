"""Near duplicates among embeddings: iterative quantisation and multi-index Hamming tables.

1. A bounded sample is centred and projected; an orthogonal rotation is learned that brings
   the projections close to the corners of a cube (iterative quantisation), so that the signs
   are balanced binary codes. Several rotations, each learned from another start, give a
   code long enough.
2. The code is cut into substrings, one for each table. Vectors with an equal substring meet
   in the table's bucket. The substrings' length follows the number of vectors, and the
   number of tables follows from it and the target recall at the threshold, as found with pairs
   at the threshold made from the sample: centring widens their angles where vectors have a common
   direction. If that takes more tables, substrings get shorter as long as this costs less.
3. Equal vectors are one node with a count, so that copies never meet. Buckets are compared in blocks of bounded size with the original vectors, in double
   precision. A pair that meets in several tables counts in the first alone. Blocks
   give each vector's number of links and a forest of its links; pairs are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_rows, components, dealt, hash_share, local_roots, mapped, runs, stored


@dataclass(frozen=True)
class EmbeddingParams:
    """``sample``: vectors that the rotations are learned from (expected number); ``bucket``: vectors that a bucket should hold on average."""

    threshold: float = 0.95
    recall: float = 0.995
    sample: int = 4000
    iterations: int = 30
    bucket: float = 6.0
    chunk: int = 512
    seed: int = 3


def substring_bits(count: int, params: EmbeddingParams) -> int:
    return int(min(48, max(6, math.ceil(math.log2(max(2, count) / params.bucket)))))


def table_count(bits: int, params: EmbeddingParams) -> int:
    """Tables with which a pair at the threshold has an equal substring in one with the target probability, if centring leaves angles as they are."""
    equal = (1 - math.acos(min(1.0, params.threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - params.recall) / math.log(1 - equal)))


def threshold_pairs(sample: np.ndarray, mean: np.ndarray, params: EmbeddingParams, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector of the sample one at the threshold from it, as far from the mean where that can be; apart from this it differs in the direction of another vector of the sample."""
    cosine = min(1.0, params.threshold)
    sine = math.sqrt(1 - cosine * cosine)

    def across(x: np.ndarray, *axes: np.ndarray) -> np.ndarray:
        """x without its parts along the axes, at length 1; rows of nothing stay nothing."""
        for axis in axes:
            x = x - np.einsum("ij,ij->i", x, axis)[:, None] * axis
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0.0)

    towards = across(np.broadcast_to(mean, sample.shape), sample)
    along = sample @ mean
    reach = np.einsum("ij,j->i", towards, mean) * sine
    part = np.clip((1 - cosine) * along / np.where(reach > 1e-12, reach, 1.0), -1.0, 1.0) * (reach > 1e-12)
    aside = across(sample[rng.permutation(len(sample))] - sample, sample, towards)
    # a vector that met its own copy differs in any direction
    aside = np.where(aside.any(1, keepdims=True), aside, across(rng.standard_normal(sample.shape), sample, towards))
    return cosine * sample + sine * unit_or_zero(part[:, None] * towards + np.sqrt(1 - part**2)[:, None] * aside)


def unit_or_zero(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0.0)


#: What a row of a table costs, in comparisons of a pair.
ROW_COST = 1000


def _tables_for(equal_bit: np.ndarray, bits: int, recall: float) -> float:
    """Tables that bring the mean probability over pairs, whose bits are equal with the given probabilities, to the recall; infinite beyond a million."""
    equal = equal_bit**bits
    low, high = 0, 1
    while np.mean(1 - (1 - equal) ** high) < recall:
        low, high = high, high * 2
        if high > 1 << 20:
            return math.inf
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if np.mean(1 - (1 - equal) ** middle) >= recall else (middle, high)
    return high


def plan_tables(sample: np.ndarray, pairs: np.ndarray, mean: np.ndarray, count: int, params: EmbeddingParams) -> tuple[int, int]:
    """(bits, tables) for the angles that pairs at the threshold have after centring. With 0 bits all vectors meet, in one table."""
    bits = substring_bits(count, params)
    least = table_count(bits, params)
    a, b = unit_or_zero(sample - mean), unit_or_zero(pairs - mean)
    equal_bit = 1 - np.arccos(np.clip(np.einsum("ij,ij->i", a, b), -1.0, 1.0)) / math.pi
    if not len(sample) or _tables_for(equal_bit, bits, params.recall) <= 1.25 * least:
        return bits, least
    needed = {n: _tables_for(equal_bit, n, params.recall) for n in range(bits + 1)}
    bits = min(needed, key=lambda n: (needed[n] * (ROW_COST + count / 2.0**n), n))
    return bits, int(needed[bits])


def found_share(quantiser: Quantiser, sample: np.ndarray, pairs: np.ndarray) -> float:
    """The share of the pairs that have an equal substring in some table."""
    step = max(1, 4_000_000 // max(1, quantiser.bits * quantiser.tables))
    met = [(quantiser.substrings(sample[i : i + step]) == quantiser.substrings(pairs[i : i + step])).any(1) for i in range(0, len(sample), step)]
    return float(np.concatenate(met).mean()) if met else 1.0


def learn_rotation(x: np.ndarray, rng: np.random.Generator, iterations: int) -> np.ndarray:
    """Alternates codes and rotation: for fixed codes the best rotation is the orthogonal Procrustes solution."""
    width = x.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    for _ in range(iterations):
        codes = np.where(x @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(x.T @ codes)
        rotation = u @ vt
    return rotation


@dataclass(frozen=True)
class Quantiser:
    mean: np.ndarray
    rotations: np.ndarray
    bits: int
    tables: int

    def substrings(self, unit: np.ndarray) -> np.ndarray:
        """The tables' substrings of each unit vector, as numbers."""
        signs = np.concatenate([(unit - self.mean) @ r >= 0 for r in self.rotations], 1)[:, : self.bits * self.tables]
        power = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return signs.reshape(len(unit), self.tables, self.bits) @ power


def learn(sample: np.ndarray, count: int, width: int, params: EmbeddingParams) -> Quantiser:
    rng = np.random.default_rng(params.seed)
    mean = sample.mean(0) if len(sample) else np.zeros(width)
    # a code bit for each direction; a mean that is most of every vector would make codes alike, so it is taken off
    centred = sample - mean
    pairs = threshold_pairs(sample, mean, params, np.random.default_rng(params.seed + 1))
    bits, tables = plan_tables(sample, pairs, mean, count, params)
    rotations: list[np.ndarray] = []
    while True:
        rotations += [learn_rotation(centred, rng, params.iterations if len(sample) else 0) for _ in range(max(1, -(-bits * tables // width)) - len(rotations))]
        made = Quantiser(mean, np.array(rotations), bits, tables)
        # learned rotations are not independent: tables are added until the codes themselves find the pairs
        if bits == 0 or found_share(made, sample, pairs) >= params.recall:
            return made
        if tables * (ROW_COST + count / 2.0**bits) > ROW_COST + count:
            bits, tables = 0, 1
        else:
            tables += -(-tables // 8)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def valid_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the vectors that can be compared, with v as doubles; of vectors that share an id the smallest."""
    v = F.col(vector_column).cast("array<double>")
    fine = F.col(vector_column).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_column).alias("vec_id"), v.alias("v"), fine.alias("fine")).filter(F.col("vec_id").isNotNull() & F.col("fine") & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_links(unit: np.ndarray, codes: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block at the threshold or above whose substrings differ in all tables before this one."""
    i, j = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
    u, v = left[i], right[j]
    if same:
        keep = u < v
        u, v = u[keep], v[keep]
    exact = np.einsum("ij,ij->i", unit[u], unit[v]) >= threshold
    u, v = u[exact], v[exact]
    if table:
        first = ~(codes[u, :table] == codes[v, :table]).any(1)
        u, v = u[first], v[first]
    return u, v


def linked(vectors: DataFrame, params: EmbeddingParams = EmbeddingParams(), *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at the threshold or above), component_id (the smallest id reachable by links) and kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do rows with a null id. Vectors of different widths are never compared. Rows
    that repeat an id get one result, of the smallest of their vectors, and are no links of
    one another. Equal vectors are linked. Ids may be of any type with an order. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    # two hashes stand for the vector: 128 bits
    good = stored(valid_vectors(vectors, id_column, vector_column).withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(1), "v")), "vectors")
    nodes = stored(good.groupBy("a", "b").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "vector-nodes")
    of = good.select("vec_id", "a", "b").join(nodes.select("a", "b", "node", "copies"), ["a", "b"]).select("vec_id", "node", "copies")
    widths = sorted((r[0], r[1]) for r in nodes.groupBy(F.size("v")).count().collect())
    links = spark.createDataFrame([], f"node {kind}, links long, root {kind}")
    for width, count in widths:
        links = links.unionByName(_linked_width(nodes.filter(F.size("v") == width).select(F.col("node").alias("vec_id"), "copies", "v"), width, count, params))
    links = stored(links, "vector-links")
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = of.join(counted, "node", "left").join(roots, "node", "left")
    known = known.select(F.col("vec_id").alias("id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    out = vectors.select(F.col(id_column).alias("vec_id")).join(known, F.col("vec_id") == F.col("id"), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("root") == F.col("vec_id"), F.lit(True)).alias("kept"))


def _linked_width(good: DataFrame, width: int, count: int, params: EmbeddingParams) -> DataFrame:
    """(node, links, root) for each block and vector of one width with a link, given with the number of its copies."""
    spark = good.sparkSession
    share = min(1.0, params.sample / count)
    found = good.filter(hash_share(F.col("vec_id"), params.seed) < share).select("v").toArrow()
    sample = unit_rows(_matrix(found.column(0))) if found.num_rows else np.zeros((0, width))
    shared = spark.sparkContext.broadcast(learn(sample, count, width, params))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                codes = quantiser.substrings(unit_rows(_matrix(part.column("v"))))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(list(codes), pa.list_(pa.int64()))], names=["vec_id", "codes"])

    kind = good.schema["vec_id"].dataType.simpleString()
    codes = mapped(good, encode, f"vec_id {kind}, codes array<long>")
    spread = codes.select("vec_id", F.posexplode("codes").alias("tab", "code"))
    shared_buckets = spread.groupBy("tab", "code").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = spread.join(shared_buckets, ["tab", "code"])
    blocks = block_rows(members, ["tab", "code"], "size", "vec_id", params.chunk)
    rows = dealt(blocks.select("blk", "vec_id", "tab", "side", "same").join(good.select("vec_id", "copies", "v"), "vec_id"), "blk")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        nodes, links, roots, held = [], [], [], 0
        for block in runs(batches, "blk"):
            ids, side = block.column("vec_id").to_numpy(), block.column("side").to_numpy()
            same, table = bool(block.column("same")[0].as_py()), block.column("tab")[0].as_py()
            left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if len(ids) < 2 or not len(left) or not len(right):
                continue
            unit = unit_rows(_matrix(block.column("v")))
            near = unit[left] @ unit[right].T >= params.threshold - 1e-9
            if near.sum() <= (len(ids) if same else 0):
                continue
            u, v = block_links(unit, quantiser.substrings(unit) if table else np.zeros((len(ids), 0)), table, left, right, same, params.threshold)
            if not len(u):
                continue
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            copies = block.column("copies").to_numpy()
            n = (np.bincount(u, weights=copies[v], minlength=len(ids)) + np.bincount(v, weights=copies[u], minlength=len(ids))).astype(np.int64)
            some = np.flatnonzero(n)
            nodes.append(ids[some])
            links.append(n[some])
            roots.append(ids[order][local_roots(len(ids), place[u], place[v])[place]][some])
            held += len(some)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, roots)], names=["node", "links", "root"])
                nodes, links, roots, held = [], [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, roots)], names=["node", "links", "root"])

    return mapped(rows, compare, f"node {kind}, links long, root {kind}")
