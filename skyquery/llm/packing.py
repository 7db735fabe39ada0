"""Best-fit packing by a linear grouping scheme.

1. Large lengths are sorted and cut into groups of equal cardinality; each length counts as
   the largest of its group.
2. Configurations - how many pieces of each group one sequence holds - are optimised by
   column generation over the few group sizes (a small linear program with a knapsack for
   the next configuration); fractional remainders are packed by best fit.
3. The actual pieces replace the rounded ones, longest first.
4. The small pieces go by best fit, longest first, into the space that is left.
5. Sequences that are not full are opened again, the loosest alone or more of them, and their
   pieces put by best fit; the plan of the fewest sequences is taken. As the last choice opens
   all, there are never more than best fit of all pieces, longest first, would make.

All of it works on the histogram of lengths, which has at most ``capacity`` entries however
many documents there are, and yields *runs*: a list of piece lengths and how many sequences
are filled with just that list. Pieces find their places by their rank among the pieces of
equal length, so no task and not the driver ever holds the pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, slices, stored
from .tokens import Encoder


@dataclass(frozen=True)
class PackingParams:
    """``large``: the shortest length that is grouped (more than a third of the capacity, so that configurations stay small); ``groups``: into how many groups of equal cardinality."""

    capacity: int = 4096
    end_id: int = 1
    large: int = 1366
    groups: int = 20
    rounds: int = 400


def pieces(docs: DataFrame, tokenizer_path: str, params: PackingParams = PackingParams(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its place ``part``, ``nth`` among the pieces of its length in its partition.

    A document is its ids and then the end id; null text is empty, so that every document has
    a piece. Only documents longer than the capacity are cut, into pieces of full capacity,
    the last of which may be shorter.
    """
    capacity, end = params.capacity, np.array([params.end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = Encoder(tokenizer_path), Counter(), TaskContext.get().partitionId()
        for rows, texts in slices(batches, "_text"):
            which, piece, length, crc, nth = [], [], [], [], []
            for i, ids in enumerate(encoder(texts)):
                ids = ids.astype("<u4").tobytes() + end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[start : start + 4 * capacity]
                    n = len(one) // 4
                    which.append(i)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(one))
                    nth.append(seen[n])
                    seen[n] += 1
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id").take(pa.array(which, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(which), part, np.int32)), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return mapped(rows, task, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


# --- the plan, from the histogram alone -------------------------------------------------


def _groups(histogram: dict[int, int], params: PackingParams) -> list[list[list[int]]]:
    """Large lengths, longest first, in groups of equal cardinality: lists of [length, count]."""
    large = [[n, c] for n, c in sorted(histogram.items(), reverse=True) if n >= params.large and c]
    total = sum(c for _, c in large)
    each = max(1, -(-total // params.groups))
    out: list[list[list[int]]] = []
    room = 0
    for n, c in large:
        while c:
            if not room:
                out.append([])
                room = each
            take = min(room, c)
            out[-1].append([n, take])
            c, room = c - take, room - take
    return out


def _knapsack(values: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest value whose sizes fit."""
    best = np.zeros(capacity + 1)
    chosen: list[list[tuple[int, np.ndarray]]] = []
    for v, s, m in zip(values, sizes.tolist(), most.tolist(), strict=True):
        steps, left, k = [], min(m, capacity // s), 1
        while v > 1e-12 and left > 0:
            k = min(k, left)
            if k * s <= capacity:
                moved = np.full(capacity + 1, -1.0)
                moved[k * s :] = best[: capacity + 1 - k * s] + k * v
                better = moved > best + 1e-12
                best = np.where(better, moved, best)
                steps.append((k, better))
            left, k = left - k, 2 * k
        chosen.append(steps)
    at, out = capacity, np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        for k, better in reversed(chosen[i]):
            if better[at]:
                out[i] += k
                at -= k * int(sizes[i])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences take each: the linear program's optimum, rounded down."""
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, min(int(capacity // sizes[i]), int(demand[i])), 0) for i in range(m)]
    basis = np.array(columns, float).T
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ demand
        prices = np.ones(m) @ inverse
        value, column = _knapsack(np.maximum(prices, 0), sizes, demand, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        before = basis[:, leaves].copy()
        basis[:, leaves] = column
        if np.linalg.cond(basis) > 1e12:
            basis[:, leaves] = before
            break
    x = np.linalg.inv(basis) @ demand
    return [(np.rint(basis[:, i]).astype(np.int64), int(np.floor(x[i] + 1e-6))) for i in range(m) if x[i] > 1 - 1e-6]


class _Space:
    """Runs by the space left in their sequences, for best fit."""

    def __init__(self):
        self.free: list[int] = []
        self.runs: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)

    def add(self, space: int, held: list[tuple[int, int]], count: int) -> None:
        if count:
            if not self.runs[space]:
                insort(self.free, space)
            self.runs[space].append((held, count))

    def best(self, length: int) -> int:
        """The smallest space that holds the length, or -1."""
        at = bisect_left(self.free, length)
        return self.free[at] if at < len(self.free) else -1

    def take(self, space: int) -> tuple[list[tuple[int, int]], int]:
        out = self.runs[space].pop()
        if not self.runs[space]:
            self.free.remove(space)
        return out


def _best_fit(space: _Space, length: int, count: int, capacity: int) -> None:
    """Puts ``count`` pieces of one length where they leave the least; as many of a run at once as there are."""
    while count:
        free = space.best(length)
        if free < 0:
            each = min(capacity // length, count)
            full = count // each
            space.add(capacity - each * length, [(length, each)], full)
            count -= full * each
            continue
        held, n = space.take(free)
        each = min(free // length, count) if count < n * (free // length) else free // length
        # one piece at a time is best fit; several of a length fit as well only while no tighter place exists
        if each > 1 and space.best(length) >= 0 and space.best(length) < free - length:
            each = 1
        moved = min(n, count // each)
        space.add(free, held, n - moved)
        space.add(free - each * length, [*held, (length, each)], moved)
        count -= moved * each


def plan(histogram: dict[int, int], params: PackingParams = PackingParams()) -> list[tuple[list[tuple[int, int]], int]]:
    """Runs: what a sequence holds, as (length, how many), and the number of such sequences."""
    groups = _groups(histogram, params)
    space = _Space()
    if groups:
        sizes = np.array([max(n for n, _ in g) for g in groups], np.int64)
        demand = np.array([sum(c for _, c in g) for g in groups], np.int64)
        merged = {int(s): 0 for s in sizes}
        for s, d in zip(sizes.tolist(), demand.tolist(), strict=True):
            merged[s] += d
        order = sorted(merged, reverse=True)
        queues: dict[int, list[list[int]]] = {s: [] for s in order}
        for g, s in zip(groups, sizes.tolist(), strict=True):
            queues[s] += [list(x) for x in g]
        few = np.array(order, np.int64)
        for column, count in sorted(configurations(few, np.array([merged[s] for s in order], np.int64), params.capacity, params.rounds), key=lambda x: -x[1]):
            slots = [s for s, k in zip(order, column.tolist(), strict=True) for _ in range(k)]
            count = min([count, *(sum(c for _, c in queues[s]) // k for s, k in zip(order, column.tolist(), strict=True) if k)])
            while count and slots:
                # the longest that each slot can take; all alike for as long as no length runs out
                need: dict[int, Counter] = defaultdict(Counter)
                heads = {s: [list(x) for x in queues[s]] for s in set(slots)}
                lengths = []
                for s in slots:
                    while not heads[s][0][1]:
                        heads[s].pop(0)
                    n = heads[s][0][0]
                    heads[s][0][1] -= 1
                    need[s][n] += 1
                    lengths.append(n)
                run = min(count, *(next(c for n2, c in queues[s] if n2 == n) // k for s in need for n, k in need[s].items()))
                run = max(1, run)
                for s in need:
                    for n, k in need[s].items():
                        entry = next(x for x in queues[s] if x[0] == n)
                        entry[1] -= k * run
                    queues[s] = [x for x in queues[s] if x[1]]
                space.add(params.capacity - sum(lengths), sorted(Counter(lengths).items(), reverse=True), run)
                count -= run
        rest = Counter()
        for s in order:
            for n, c in queues[s]:
                rest[n] += c
        for n in sorted(rest, reverse=True):
            _best_fit(space, n, rest[n], params.capacity)
    for n in sorted((n for n in histogram if n < params.large), reverse=True):
        _best_fit(space, n, histogram[n], params.capacity)
    made = [run for free in sorted(space.runs) for run in space.runs[free]]
    plans = [made, *(_reopened(made, limit, params.capacity) for limit in (params.capacity // 3, params.capacity // 30, 0, -1))]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _reopened(made: list[tuple[list[tuple[int, int]], int]], limit: int, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The runs after those with more space than the limit are opened and their pieces put, longest first, where they leave the least. With -1 this is best fit of all pieces."""
    space, loose = _Space(), Counter()
    for held, count in made:
        free = capacity - sum(n * each for n, each in held)
        if free <= limit:
            space.add(free, held, count)
            continue
        for n, each in held:
            loose[n] += each * count
    for n in sorted(loose, reverse=True):
        _best_fit(space, n, loose[n], capacity)
    return [run for free in sorted(space.runs) for run in space.runs[free]]


@dataclass(frozen=True)
class Places:
    """For each length the runs of ranks: ``first`` rank, first sequence, pieces of the length in each sequence, and the offset of its first."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray


def places(runs: list[tuple[list[tuple[int, int]], int]]) -> Places:
    rows, base = [], 0
    at: Counter = Counter()
    for held, count in runs:
        offset = 0
        for n, each in held:
            rows.append((n, at[n], base, each, offset))
            at[n] += each * count
            offset += n * each
        base += count
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Places(*(np.ascontiguousarray(c) for c in columns))


def pack(made: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Gives each row of ``pieces`` (stored, so that it is not made anew) its sequence_id and offset.

    An empty table gives an empty result. Ties between pieces of equal length are broken by
    partition and place in it.
    """
    spark = made.sparkSession
    counts = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {int(r[0]): int(r[1]) for r in made.groupBy("length").agg(F.count(F.lit(1))).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, params)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        top = int(p.first.max() + p.sequence.max() + 2) if len(p.first) else 1
        key = p.length.astype(object) * (2 * top) + p.first if len(p.length) and int(p.length.max()) * 4 * top > 2**62 else p.length * (2 * top) + p.first
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("base").to_numpy() + b.column("nth").to_numpy()
            at = np.searchsorted(key, length * (2 * top) + rank, side="right") - 1
            inside = rank - p.first[at]
            sequence = p.sequence[at] + inside // p.each[at]
            offset = p.offset[at] + inside % p.each[at] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kind = made.schema["doc_id"].dataType.simpleString()
    return mapped(made.join(starts, ["length", "part"]), task, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, params: PackingParams = PackingParams(), **columns: str) -> DataFrame:
    """All documents in sequences of at most the capacity: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, tokenizer_path, params, **columns), "pieces"), params)
