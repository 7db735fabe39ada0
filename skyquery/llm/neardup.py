"""N-gram Jaccard join: MinHash LSH forest over word shingles, then exact verification.

1. Each text becomes the set of 64-bit hashes of its runs of five words, and a MinHash
   signature. Equal sets collapse to one node, so that exact copies are never compared.
2. The signature is cut into trees. A node's label in a tree is a sequence of minima, kept whole as a
   number that sorts like the sequence; labels with a common prefix lie together in the tree's sorted trie.
3. Every node begins with whole labels and shortens the matched prefix tree by tree, first where
   this adds the fewest others, until a partner at the threshold meets it in some
   tree with the target probability (``shortened``). In tries that are crowded below a short prefix,
   by common phrases or by copies, nodes so keep long ones. Each node is compared with all others below its prefixes.
4. These pairs are compared by their signatures, in blocks of bounded size. Likely pairs form
   clusters.
5. A cluster's member keeps only how its set differs from that of the cluster's
   representative. These differences give the exact Jaccard similarity of all pairs of a
   cluster, in blocks again: |A| + |B| less what the differences do not share is twice what the sets share. Blocks
   give each node's number of links and a forest of its links; pairs are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_rows, components, dealt, HashedWords, local_roots, mapped, runs, slices, stored

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDupParams:
    """``depth``: minima in a label, 8 at most; ``recall``: probability that a pair at the threshold meets in a trie; ``chunk``, ``verify_chunk``, ``weight``: nodes of a comparing and of a verifying block's side, and shingles of the latter."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    recall: float = 0.999
    chunk: int = 400
    verify_chunk: int = 64
    weight: int = 2_000_000
    seed: int = 9

    @property
    def near(self) -> float:
        """Estimated similarity from which a pair is worth verifying: four standard errors below the threshold."""
        return self.threshold - 4 * math.sqrt(self.threshold * (1 - self.threshold) / (self.trees * self.depth))


def forest_depth(params: NearDupParams) -> int:
    """The prefix down to which all trees must be shortened at worst: the longest with which a pair at the threshold meets in one of them with the target probability."""
    for depth in range(params.depth, 0, -1):
        if 1 - (1 - params.threshold**depth) ** params.trees >= params.recall:
            return depth
    raise ValueError(f"{params.trees} trees do not find pairs at {params.threshold} with probability {params.recall}")


def levels(params: NearDupParams) -> list[int]:
    """The prefix lengths that a node goes through, whole labels first."""
    base = forest_depth(params)
    return sorted({params.depth, (params.depth + base + 1) // 2, base}, reverse=True)


def shortened(sizes: np.ndarray, params: NearDupParams) -> np.ndarray:
    """For nodes x trees x levels of trie sizes (nodes below the prefix, the node included) the level of each tree.

    Every node begins with whole labels. The step that costs the fewest others for the
    probability it adds is taken until a pair at the threshold is missed with a probability of
    1 - recall at most. Where nothing else lies below the shortest prefix a step costs nothing.
    """
    missed = np.log1p(-(params.threshold ** np.array(levels(params), float)))
    level = np.zeros(sizes.shape[:2], np.int64)
    last = len(missed) - 1
    while True:
        open_ = np.flatnonzero(missed[level].sum(1) > math.log(1 - params.recall) + 1e-12)
        open_ = open_[(level[open_] < last).any(1)]
        if not len(open_):
            return level
        now = level[open_]
        then = np.minimum(now + 1, last)
        own = sizes[open_]
        more = np.take_along_axis(own, then[:, :, None], 2)[:, :, 0] - np.take_along_axis(own, now[:, :, None], 2)[:, :, 0]
        cost = np.where(now < last, more / np.maximum(missed[now] - missed[then], 1e-12), np.inf)
        tree = cost.argmin(1)
        level[open_, tree] += 1


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; fewer words than n are one run."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ words[i : len(words) - n + 1 + i]) * _MULTIPLY
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _permutations(params: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(params.seed)
    k = params.trees * params.depth
    return rng.integers(1, 2**32, k, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each of the permutations of 32 bits over the shingles."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(low), 512):
        mixed = low[i : i + 512, None] * a + b
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        np.minimum(out, mixed.min(0), out=out)
    return out


def labels(low: np.ndarray, params: NearDupParams) -> np.ndarray:
    """Two numbers for each tree: 16 bits of its first four minima and of the others, so that prefixes are shifts and labels sort like sequences."""
    short = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64).reshape(params.trees, params.depth)
    out = np.zeros((params.trees, 8), np.uint64)
    out[:, : params.depth] = short
    place = np.uint64(16) * np.arange(3, -1, -1, dtype=np.uint64)
    return np.stack([(out[:, :4] << place).sum(1, dtype=np.uint64), (out[:, 4:] << place).sum(1, dtype=np.uint64)]).view(np.int64)


def prefix(depth: int) -> list[Column]:
    """The first minima of the labels (high, low)."""
    cut_off = lambda column, bits: F.lit(0).cast("long") if bits >= 64 else F.shiftrightunsigned(column, bits)
    return [cut_off("high", 16 * max(0, 4 - depth)).alias("p"), cut_off("low", 16 * min(4, 8 - depth)).alias("q")]


def sketches(docs: DataFrame, params: NearDupParams, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, mark, node, n, signature, high, low) of each row: a hash of the text, hash and size of its shingle set (node null if it is empty), a byte of each minimum, and its label in each tree."""
    if not 0 < params.depth <= 8:
        raise ValueError("a label has 1 to 8 minima")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, (a, b) = HashedWords(), _permutations(params)
        for part, texts in slices(batches, "_text"):
            words, counts = hashed(texts)
            at, node, size, signature, label = 0, [], [], [], []
            for n in counts.tolist():
                s = shingle_hashes(words[at : at + n], params.words)
                at += n
                if not len(s):
                    node.append(None)
                    size.append(0)
                    signature.append(None)
                    label.append((None, None))
                    continue
                low = minima(s, a, b)
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                size.append(len(s))
                signature.append((low >> np.uint32(7)).astype(np.uint8).tobytes())
                label.append(labels(low, params))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("mark"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(signature, pa.binary()), *(pa.array([x[k] for x in label], pa.list_(pa.int64())) for k in (0, 1))],
                names=["doc_id", "mark", "node", "n", "signature", "high", "low"],
            )

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.xxhash64(text_column).alias("mark"))
    kind = rows.schema["_id"].dataType.simpleString()
    return mapped(rows, task, f"doc_id {kind}, mark long, node long, n int, signature binary, high array<long>, low array<long>")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes of each signature of a with each of b, less what equals by chance."""
    out = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        out += a[:, j][:, None] == b[:, j][None, :]
    share = out / a.shape[1]
    return (share - 1 / 256) / (1 - 1 / 256)


def _pairs(mask: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(mask)
    u, v = left[i], right[j]
    if same:
        keep = u < v
        u, v = u[keep], v[keep]
    return u, v


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = block.column("side").to_numpy()
    same = bool(block.column("same")[0].as_py())
    return (np.arange(len(side)), np.arange(len(side)), True) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)


def forest(nodes: DataFrame, params: NearDupParams) -> DataFrame:
    """(tree, level, p, q, size, node, asks) for the nodes (node, high, low): the tries' groups of more than one node that some node of the group asks for, having shortened its prefix just so far."""
    depths = levels(params)
    spread = nodes.select("node", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "x")).select("node", "tree", "x.high", "x.low")
    sized = spread
    for k, depth in reversed(list(enumerate(depths))):
        # nodes alone below the shortest prefix are alone below all
        group = spread.groupBy("tree", *prefix(depth)).agg(F.count(F.lit(1)).alias(f"s{k}"))
        if k + 1 == len(depths):
            group = group.filter(f"s{k} > 1")
        names = [f"p{k}", f"q{k}"]
        here = sized.select("*", *[c.alias(n) for c, n in zip(prefix(depth), names, strict=True)])
        sized = here.join(group.withColumnsRenamed({"p": names[0], "q": names[1]}), ["tree", *names]).drop(*names)
        if k + 1 == len(depths):
            spread = sized = stored(sized, "tries")
    each = F.struct("tree", "high", "low", *[f"s{k}" for k in range(len(depths))])
    by_node = sized.groupBy("node").agg(F.collect_list(each).alias("tries"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries = batch.column("tries")
            flat, count = tries.flatten(), np.diff(tries.offsets.to_numpy())
            owner, tree = np.repeat(np.arange(batch.num_rows), count), flat.field("tree").to_numpy()
            found = np.stack([flat.field(f"s{k}").to_numpy() for k in range(len(depths))], 1)
            sizes = np.ones((batch.num_rows, params.trees, len(depths)), np.int64)
            sizes[owner, tree] = found
            asked = shortened(sizes, params)[owner, tree]
            # a group of one asks in vain
            row, level = np.nonzero(found > 1)
            node = batch.column("node").take(pa.array(owner[row]))
            some = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [node, pa.array(tree[row].astype(np.int32)), pa.array(level.astype(np.int32)), flat.field("high").take(some), flat.field("low").take(some), pa.array(found[row, level]), pa.array(asked[row] == level)],
                names=["node", "tree", "level", "high", "low", "size", "asks"],
            )

    rows = mapped(by_node, task, "node long, tree int, level int, high long, low long, size long, asks boolean")
    at = lambda i: F.coalesce(*[F.when(F.col("level") == k, prefix(depth)[i]) for k, depth in enumerate(depths)])
    rows = stored(rows.select("node", "tree", "level", at(0).alias("p"), at(1).alias("q"), "size", "asks"), "forest")
    asked = rows.groupBy("tree", "level", "p", "q").agg(F.max("asks").alias("any")).filter("any").drop("any")
    return rows.join(asked, ["tree", "level", "p", "q"])


def likely_links(nodes: DataFrame, params: NearDupParams) -> DataFrame:
    """Edges (u, v) that connect the nodes (node, n, signature, high, low) whose signatures agree enough, for each that meet in the forest; a forest of each block, not all pairs."""
    members = forest(nodes.select("node", "high", "low"), params).join(nodes.select("node", "n", "signature"), "node")
    blocks = block_rows(members, ["tree", "level", "p", "q"], "size", "node", params.chunk)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u_out: list[np.ndarray] = []
        v_out: list[np.ndarray] = []
        held = 0
        for block in runs(batches, "blk"):
            node, n, signature = block.column("node").to_numpy(), block.column("n").to_numpy().astype(np.int64), _signatures(block.column("signature"))
            asks = block.column("asks").to_numpy()
            left, right, same = _sides(block)
            if not len(left) or not len(right) or len(node) < 2:
                continue
            mask = _agreement(signature[left], signature[right]) >= params.near
            mask &= np.minimum.outer(n[left], n[right]) >= params.threshold * np.maximum.outer(n[left], n[right]) - 1e-9
            mask &= np.logical_or.outer(asks[left], asks[right])
            u, v = _pairs(mask, left, right, same)
            if len(u):
                root = local_roots(len(node), u, v)
                moved = np.flatnonzero(root != np.arange(len(node)))
                u_out.append(node[moved])
                v_out.append(node[root[moved]])
                held += len(moved)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u_out)), pa.array(np.concatenate(v_out))], names=["u", "v"])
                u_out, v_out, held = [], [], 0
        if u_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u_out)), pa.array(np.concatenate(v_out))], names=["u", "v"])

    return mapped(dealt(blocks.select("blk", "node", "n", "signature", "asks", "side", "same"), "blk"), task, "u long, v long").distinct()


def _common(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many members the pairs of sets have in common."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(u) <= 4 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(u.tolist(), v.tolist(), strict=True)), np.int64, len(u))
    used, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    flat = np.concatenate([sets[i] for i in used.tolist()])
    owner = np.repeat(np.arange(len(used)), sizes[used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    product = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + width + 1, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        dense = np.zeros((len(used), width), np.float32)
        dense[owner[part], column[part] - k * width] = 1
        product += dense @ dense.T
    return np.rint(product[back[: len(u)], back[len(u) :]]).astype(np.int64)


def differences(texts: DataFrame, params: NearDupParams) -> DataFrame:
    """(cluster, size, node, n, copies, diff) for the rows (cluster, size, node, n, copies, text): the shingles that are in the node's set or in that of the cluster's smallest node, but not in both."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for part, found in slices(batches):
            words, counts = hashed(found)
            end = np.cumsum(counts)
            sets = [shingle_hashes(words[e - n : e], params.words).tobytes() for e, n in zip(end.tolist(), counts.tolist(), strict=True)]
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    rows = texts.select("cluster", "size", "node", "n", "copies", "text")
    # written first: a join straight on shuffles is one whose hot keys, clusters of very many nodes, can be split
    sets = stored(mapped(rows, shingle, "cluster long, size long, node long, n int, copies long, shingles binary"), "shingles")
    # the representative's set goes to each part of its cluster, so that no task gets the whole one
    parts = (F.col("size") / F.lit(params.verify_chunk)).cast("int")
    base = sets.filter("node = cluster").dropDuplicates(["cluster"]).select("cluster", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("shingles").alias("base"))
    sets = sets.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("shingles").to_pylist(), batch.column("base").to_pylist(), strict=True)
            diff = [np.setxor1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True).tobytes() for a, b in pairs]
            kept = ["cluster", "size", "node", "n", "copies"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(diff, pa.binary())], names=[*kept, "diff"])

    return mapped(sets.join(base, ["cluster", "part"]), differ, "cluster long, size long, node long, n int, copies long, diff binary")


def verified(texts: DataFrame, params: NearDupParams) -> DataFrame:
    """Exact links within clusters of the rows (cluster, size, node, n, copies, text), where ``size`` tells by its multiple of ``verify_chunk`` into how many parts the cluster is dealt.

    Returns for each block and node with a link: node, links (other documents, copies
    counted), root (the smallest node it is linked with in the block) and alone (the block is the whole cluster).
    """
    blocks = block_rows(differences(texts, params), ["cluster"], "size", "node", params.verify_chunk)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, "blk"):
            # rows that repeat both id and text bring their node twice
            block = block.take(np.sort(np.unique(block.column("node").to_numpy(), return_index=True)[1]))
            node, n, copies = (block.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "copies"))
            left, right, same = _sides(block)
            if not len(left) or not len(right) or len(node) < 2:
                continue
            mask = np.minimum.outer(n[left], n[right]) >= params.threshold * np.maximum.outer(n[left], n[right]) - 1e-9
            u, v = _pairs(mask, left, right, same)
            if not len(u):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in block.column("diff").to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            apart = sizes[u] + sizes[v] - 2 * _common(sets, u, v)
            # what two sets share, from their sizes and how they differ
            both = (n[u] + n[v] - apart) // 2
            good = both / np.maximum(1, n[u] + n[v] - both) >= params.threshold - 1e-12
            u, v = u[good], v[good]
            if not len(u):
                continue
            links = np.bincount(u, weights=copies[v], minlength=len(node)) + np.bincount(v, weights=copies[u], minlength=len(node))
            order = np.argsort(node)
            place = np.empty(len(node), np.int64)
            place[order] = np.arange(len(node))
            root = node[order][local_roots(len(node), place[u], place[v])[place]]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some]), pa.array([bool(block.column("alone")[0].as_py())] * len(some))], names=["node", "links", "root", "alone"]
            )

    return mapped(dealt(blocks.select("blk", "node", "n", "copies", "diff", "side", "same", "alone"), "blk"), task, "node long, links long, root long, alone boolean")


def classes(docs: DataFrame, params: NearDupParams = NearDupParams(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest id reachable by links), n_links (other documents at the threshold or above) and kept (the row is its class's first).

    Words are what stands between ASCII white space, unchanged; a text of fewer words than a
    shingle has one shingle of them all. Texts without a word are linked with nothing and
    are classes of their own. Rows with equal sets are copies and linked with one
    another. A null id is a class id only where all of a class are null. Of rows that repeat an id, in one class,
    all are kept or none.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    made = stored(sketches(source, params), "sketches")
    full = made.filter("node is not null")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("high").alias("high"), F.first("low").alias("low"))
    nodes = stored(nodes, "nodes")
    clusters = components(likely_links(nodes, params)).select("node", F.col("root").alias("cluster"))
    inside = clusters.join(nodes.select("node", "first", "n", "copies"), "node")
    # into how many parts a cluster is dealt follows from its nodes, and from their shingles where texts are long
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(params.verify_chunk)), F.ceil(F.sum("n") / F.lit(params.weight)))
    inside = inside.join(inside.groupBy("cluster").agg((parts * params.verify_chunk).alias("size")), "cluster")
    # one text of each node that is in a cluster: a row of its smallest id whose set it is
    bearer = made.select("doc_id", "mark", F.col("node").alias("of")).join(inside, (F.col("of") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first")), "inner").dropDuplicates(["node"])
    marked = source.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_mark"))
    texts = marked.join(bearer, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark")))
    texts = texts.select("cluster", "size", "node", "n", "copies", "text")
    links = stored(verified(texts, params), "links")
    joined = links.filter("not alone").select(F.col("node").alias("u"), F.col("root").alias("v"))
    wide = components(joined)
    roots = links.filter("alone").select("node", "root").union(wide.select("node", "root")).distinct()
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first", "copies").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("first").alias("class_id"))
    final = known.join(named, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = made.select("doc_id", "node").join(final, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))
