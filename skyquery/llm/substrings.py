"""Substring dedup: suffix automata of reference shards, and matching statistics against them.

A window is ``length`` consecutive words. Every window belongs to the shard of its minimiser,
the smallest hash of the runs of ``anchor`` words in it; consecutive windows of one minimiser
travel together as a span. Equal windows have equal minimisers, so a shard holds all the
occurrences of its windows, and only minimisers that occur twice need any text.

A span carries a hash of its words. Where all spans of a shard are alike, every occurrence but
the first is repeated. In the other shards the distinct span texts are read in the order of
their first occurrence. A suffix automaton of the reference - what has been read so far - grows word by word; at each
word the longest suffix that occurred before is known (the matching statistic), and a window
is repeated exactly if that suffix is at least as long as the window. The windows that are
repeated make the maximal spans that are removed.

A shard of more than ``hot`` distinct spans is dealt to finer shards, by minimisers of longer
runs, down to whole windows; their automata tell the same. So no task gets more than so many
spans, whatever a passage is repeated with.

Broadcasting all shards to all documents would cost shards times documents; here documents'
spans are dealt to the shard that can match them. ``removed_by_reference`` broadcasts
the automata of an outside reference, one for each of its shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, HashedWords, mapped, runs, slices, stored

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SubstringParams:
    """``hot``: distinct spans of a shard beyond which it is dealt to finer shards; ``salts``: parts in which the spans of such shards are counted and marked; ``reference``: words of an outside reference in one broadcast automaton."""

    length: int = 20
    anchor: int = 6
    hot: int = 500
    salts: int = 64
    reference: int = 200_000

    @property
    def anchors(self) -> tuple[int, ...]:
        """Words of the runs whose minimisers name the shards, level by level; the last are whole windows."""
        first = min(self.anchor, self.length)
        return tuple(sorted({first, (first + self.length + 1) // 2, self.length}))


class SuffixAutomaton:
    """Online suffix automaton over numbers. ``extend`` returns the length of the longest suffix that also ends earlier."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.last = [-1], [0], 0

    def extend(self, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]

    def match(self, words: list[int]) -> list[int]:
        """Matching statistics of other words: at each the length of the longest suffix that the automaton's text contains."""
        state = size = 0
        out = []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            else:
                state = size = 0
            out.append(size)
        return out


def repeated_windows(texts: list[bytes], length: int) -> list[list[int]]:
    """For each text the starts of the windows that occurred before: in an earlier text, or earlier in it."""
    automaton, number, out = SuffixAutomaton(), {}, []
    extend = automaton.extend
    for text in texts:
        # every text starts behind a separator of its own, which no match can cross
        extend(-1 - len(out))
        found = []
        for at, word in enumerate(text.split()):
            if extend(number.setdefault(word, len(number))) >= length:
                found.append(at - length + 1)
        out.append(found)
    return out


def _run_keys(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[start:end]: sums of the values by powers of an odd number, so that all runs come from one running sum."""
    base = 0x9E3779B97F4A7C15
    power = np.cumprod(np.full(len(h), base, np.uint64))
    back = np.cumprod(np.full(len(h), pow(base, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * back)])
    key = (total[end] - total[start]) * power[start] + (end - start).astype(np.uint64)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _minimisers(h: np.ndarray, counts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Spans of texts with word hashes h, by the minimisers of runs of k words: text, first window, number of windows, minimiser, hash of the words, and whether the minimiser occurs in the span twice."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(h) < length:
        return none
    g = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        g = (g ^ h[i : len(h) - k + 1 + i]) * _MULTIPLY
        g ^= g >> np.uint64(32)
    width, low, step = length - k + 1, g, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(g) - width + 1], low[width - step :])
    end = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)[: len(low)]
    at = np.arange(len(low))
    inside = at + length <= end[text]
    # where a run of windows of one minimiser and one text begins
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (low[1:] == low[:-1]) & (text[1:] == text[:-1]))
    starts = np.flatnonzero(first)
    stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~first[1:], False)) + 1
    again = np.zeros(len(g) + 1, np.int64)
    for d in range(1, width + 1):
        if d < len(g):
            again[1 : len(g) - d + 1] |= g[:-d] == g[d:]
    total = np.cumsum(again)
    twice = total[np.minimum(stop - 1 + width, len(g))] - total[starts] > 0
    return text[starts], starts - (end - counts)[text[starts]], stop - starts, low[starts].view(np.int64), _run_keys(h, starts, stop + length - 1), twice


def _spans(docs: DataFrame, params: SubstringParams) -> DataFrame:
    """(doc, mark, start, windows, shard, key, twice) of all spans of the documents (doc, mark, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for part, texts in slices(batches):
            text, start, windows, low, key, twice = _minimisers(*hashed(texts), params.length, params.anchors[0])
            for i in range(0, len(text), 50_000):
                k = slice(i, i + 50_000)
                which = pa.array(text[k])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(which), part.column("mark").take(which), pa.array(start[k].astype(np.int32)), pa.array(windows[k].astype(np.int32)), pa.array(low[k]), pa.array(key[k]), pa.array(twice[k].astype(bool))],
                    names=["doc", "mark", "start", "windows", "shard", "key", "twice"],
                )

    return mapped(docs, task, f"doc {_kind(docs, 'doc')}, mark long, start int, windows int, shard long, key long, twice boolean")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _texts(found: DataFrame, params: SubstringParams) -> DataFrame:
    """(doc, mark, start, shard, key, hot, content) of the spans listed with each document's text."""
    length = params.length

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            spans = part.column("spans")
            bounds, flat = spans.offsets.to_numpy(), spans.values
            starts, windows = (flat.field(c).to_numpy().tolist() for c in ("start", "windows"))
            which, content = [], []
            for i, text in enumerate(texts):
                words = (text or b"").split()
                for j in range(bounds[i], bounds[i + 1]):
                    which.append(i)
                    content.append(b" ".join(words[starts[j] : starts[j] + windows[j] + length - 1]))
            listed, at = flat.slice(bounds[0], bounds[-1] - bounds[0]), pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(at), part.column("mark").take(at), *(listed.field(c) for c in ("start", "shard", "key", "hot")), pa.array(content, pa.binary())],
                names=["doc", "mark", "start", "shard", "key", "hot", "content"],
            )

    return mapped(found, task, f"doc {_kind(found, 'doc')}, mark long, start int, shard long, key long, hot boolean, content binary")


def _marked_hot(distinct: DataFrame, params: SubstringParams) -> DataFrame:
    """The distinct spans of the shards that hold more than one kind, or one twice in itself, with ``hot``: the shard is to be dealt anew.

    The spans of hot shards are marked in ``salts`` parts each, so that no task gets a whole one. There are at most count / hot such shards.
    """
    kinds = distinct.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any_twice")).filter("n > 1 or any_twice")
    parts = kinds.filter(F.col("n") > params.hot).select("shard", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt"), F.lit(True).alias("hot"))
    salted = distinct.withColumn("salt", F.pmod("key", F.lit(params.salts)).cast("int")).join(parts, ["shard", "salt"], "left").drop("salt")
    cold = salted.filter("hot is null").join(kinds.filter(F.col("n") <= params.hot).select("shard"), "shard")
    return cold.withColumn("hot", F.lit(False)).unionByName(salted.filter("hot"))


_HITS = "shard long, key long, hits array<int>"


def _by_automaton(contents: DataFrame, params: SubstringParams) -> DataFrame:
    """(shard, key, hits) of distinct contents, given with their first occurrences: the windows that occurred before, counted from the content's first."""
    rows = dealt(contents.select("shard", "doc", "mark", "start", "key", "content"), "shard", "doc", "mark", "start")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, keys, hits = [], [], []
        for shard in runs(batches, "shard"):
            # rows that repeat both id and text bring their spans twice
            shard = shard.take(np.sort(np.unique(shard.column("key").to_numpy(), return_index=True)[1]))
            found = repeated_windows(shard.column("content").to_pylist(), params.length)
            some = [i for i, f in enumerate(found) if f]
            if some:
                shards += [shard.column("shard")[0].as_py()] * len(some)
                keys += shard.column("key").take(pa.array(some)).to_pylist()
                hits += [found[i] for i in some]
            if len(keys) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(keys, pa.int64()), pa.array(hits, pa.list_(pa.int32()))], names=["shard", "key", "hits"])
                shards, keys, hits = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(keys, pa.int64()), pa.array(hits, pa.list_(pa.int32()))], names=["shard", "key", "hits"])

    return mapped(rows, task, _HITS)


def _dealt_anew(contents: DataFrame, params: SubstringParams, anchor: int) -> DataFrame:
    """(shard, key, part, own, at, doc, mark, start, windows, twice, content, sure): the contents cut into spans of finer shards ``part``, with their hashes ``own`` and places ``at`` in the content.

    A span that its content has had before is repeated and needs no row: its windows are listed in ``sure`` of the content's first row.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for rows, texts in slices(batches, "content"):
            text, at, windows, low, own, twice = _minimisers(*hashed(texts), params.length, anchor)
            fresh = np.sort(np.unique(np.stack([text, low, own], 1), axis=0, return_index=True)[1])
            again = np.setdiff1d(np.arange(len(text)), fresh, assume_unique=True)
            sure: dict[int, list[int]] = {}
            for i, a, n in zip(text[again].tolist(), at[again].tolist(), windows[again].tolist(), strict=True):
                sure.setdefault(i, []).extend(range(a, a + n))
            text, at, windows, low, own, twice = (x[fresh] for x in (text, at, windows, low, own, twice))
            words, which = [t.split() for t in texts], pa.array(text)
            content = [b" ".join(words[i][a : a + n + params.length - 1]) for i, a, n in zip(text.tolist(), at.tolist(), windows.tolist(), strict=True)]
            start = rows.column("start").take(which).to_numpy() + at
            kept = [rows.column(c).take(which) for c in ("shard", "key", "doc", "mark")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(low), pa.array(own), pa.array(at.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(twice.astype(bool)), pa.array(content, pa.binary()), pa.array([sure.pop(i, []) for i in text.tolist()], pa.list_(pa.int32()))],
                names=["shard", "key", "doc", "mark", "part", "own", "at", "start", "windows", "twice", "content", "sure"],
            )

    return mapped(contents.select("shard", "key", "doc", "mark", "start", "content"), task, f"shard long, key long, doc {_kind(contents, 'doc')}, mark long, part long, own long, at int, start int, windows int, twice boolean, content binary, sure array<int>")


def _repeats(contents: DataFrame, params: SubstringParams, level: int = 0) -> DataFrame:
    """(shard, key, hits) of the contents marked ``hot`` or not, as ``_by_automaton`` for their shard or its finer parts."""
    told = _by_automaton(contents.filter("not hot"), params)
    if level + 1 == len(params.anchors):
        # a part is one window: its contents differ no more
        return told.unionByName(_by_automaton(contents.filter("hot"), params))
    spans = stored(_dealt_anew(contents.filter("hot"), params, params.anchors[level + 1]), f"spans-{level + 1}")
    place = F.struct("doc", "mark", "start")
    distinct = spans.groupBy(F.col("part").alias("shard"), F.col("own").alias("key")).agg(F.min(place).alias("first"), F.max("twice").alias("twice"), F.first("content").alias("content"))
    distinct = stored(distinct, f"distinct-spans-{level + 1}")
    inner = _repeats(_marked_hot(distinct, params).select("shard", "key", "hot", "first.doc", "first.mark", "first.start", "content"), params, level + 1)
    known = distinct.select(F.col("shard").alias("part"), F.col("key").alias("own"), "first").join(inner.select(F.col("shard").alias("part"), F.col("key").alias("own"), "hits"), ["part", "own"], "left")
    found = spans.drop("content").join(stored(known, f"repeats-{level + 1}"), ["part", "own"])
    return told.unionByName(_windows(found, "at", place).groupBy("shard", "key").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("hits")))


def _windows(found: DataFrame, at: str, place) -> DataFrame:
    """The spans that have repeated windows, with these as ``w``: those of ``hits`` in the first occurrence of their words, and all in others, and those that are ``sure`` besides. They are counted from ``at``."""
    own = F.transform(F.coalesce("hits", F.array().cast("array<int>")), lambda h: h + F.col(at))
    every = F.sequence(F.col(at), F.col(at) + F.col("windows") - 1)
    w = F.when(place.eqNullSafe(F.col("first")), own).otherwise(every)
    return found.withColumn("w", F.concat(w, "sure") if "sure" in found.columns else w).filter(F.size("w") > 0)


def removed(docs: DataFrame, params: SubstringParams = SubstringParams(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its remaining words joined by one space) and spans (the maximal removed runs of words: first, end).

    Words stand between ASCII white space, unchanged; null text has none. A word is removed
    if a window covers it whose words also start earlier: in a document of smaller id (null
    is smallest), or in the same one. Documents that share an id are ordered by a hash of their
    texts; rows that repeat id and text alike are one document, and all get its result.
    """
    source = docs.select(F.col(id_column).alias("doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    source = source.withColumn("mark", F.xxhash64("text"))
    same = lambda a, b: F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))
    # occurrences of spans that some window can have in common with another
    spans = _spans(source, params)
    shared = spans.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.max("twice").alias("any_twice")).filter("size > 1 or any_twice").select("shard")
    occurs = stored(spans.join(shared, "shard"), "spans")
    # distinct spans with their first occurrence, and of those the ones that are not all their shard has
    distinct = stored(occurs.groupBy("shard", "key").agg(F.min(F.struct("doc", "mark", "start")).alias("first"), F.max("windows").alias("windows"), F.max("twice").alias("twice")), "distinct-spans")
    mixed = _marked_hot(distinct, params)
    by_doc = mixed.groupBy("first.doc", "first.mark").agg(F.collect_list(F.struct("first.start", "windows", "shard", "key", "hot")).alias("spans"))
    contents = stored(_texts(source.alias("d").join(by_doc.alias("s"), same("d", "s")).select("d.doc", "d.mark", "d.text", "s.spans"), params), "span-texts")
    known = stored(distinct.select("shard", "key", "first").join(_repeats(contents, params), ["shard", "key"], "left"), "repeats")
    found = occurs.select("doc", "mark", "start", "windows", "shard", "key").join(known, ["shard", "key"])
    windows = _windows(found, "start", F.struct("doc", "mark", "start"))
    gone = windows.groupBy("doc", "mark").agg(F.flatten(F.collect_list("w")).alias("gone"))
    return _cut_out(source.alias("d").join(gone.alias("g"), same("d", "g"), "left").select("d.doc", "d.text", "g.gone"), params)


def _cut_out(rows: DataFrame, params: SubstringParams) -> DataFrame:
    """Removes the words that the windows starting at ``gone`` cover."""
    length = params.length

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            total, lost, kept, runs_ = [], [], [], []
            for text, gone in zip(texts, part.column("gone"), strict=True):
                words = text.split()
                total.append(len(words))
                if not gone.is_valid or not len(gone.values):
                    lost.append(0)
                    kept.append(b" ".join(words))
                    runs_.append([])
                    continue
                change = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(gone.values.to_numpy())
                np.add.at(change, starts, 1)
                np.add.at(change, starts + length, -1)
                bad = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], bad.astype(np.int8), [0]])))
                lost.append(int(bad.sum()))
                runs_.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~bad).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(runs_, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return mapped(rows, task, f"doc_id {_kind(rows, 'doc')}, n_words long, n_removed long, kept string, spans array<struct<first:int,end:int>>")


def _reference_shards(reference: DataFrame, params: SubstringParams) -> tuple[DataFrame, int]:
    """(words, shard) of the reference's texts, cut where they are long into pieces that overlap by a window less a word, and the number of shards."""
    words = reference.select(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")).filter(F.size("w") >= params.length)
    total = words.agg(F.sum(F.size("w"))).first()[0] or 0
    step = max(params.length, params.reference // 4)
    pieces = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - params.length, F.lit(step)), lambda i: F.slice("w", i + 1, step + params.length - 1))).alias("words"))
    shards = max(1, -(-int(total) // params.reference))
    return pieces.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards))), shards


def removed_by_reference(docs: DataFrame, reference: DataFrame, params: SubstringParams = SubstringParams(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``removed``, but of the windows that occur in a reference (column ``text``), in shards whose automata are broadcast one after another.

    Each shard has about ``params.reference`` words and costs one pass over the documents, so this is for
    references that stay small beside them. Null texts of the reference have no windows.
    """
    source = docs.select(F.col(id_column).alias("doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = _kind(source, "doc")
    pieces, shards = _reference_shards(reference, params)
    hits = None
    for k in range(shards):
        automaton, number = SuffixAutomaton(), {}
        for i, (words,) in enumerate(pieces.filter(F.col("shard") == k).select("words").toLocalIterator()):
            automaton.extend(-1 - i)
            for word in words:
                automaton.extend(number.setdefault(word.encode(), len(number)))
        shared = docs.sparkSession.sparkContext.broadcast((automaton.next, automaton.link, automaton.len, number))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = SuffixAutomaton()
            a.next, a.link, a.len, number = shared.value
            for part, texts in slices(batches):
                which, hits = [], []
                for i, text in enumerate(texts):
                    sizes = a.match([number.get(w, -(10**9)) for w in text.split()])
                    found = [i - params.length + 1 for i, n in enumerate(sizes) if n >= params.length]
                    if found:
                        which.append(i)
                        hits.append(found)
                at = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc").take(at), part.column("mark").take(at), pa.array(hits, pa.list_(pa.int32()))], names=["doc", "mark", "w"])

        made = stored(mapped(source, task, f"doc {kind}, mark long, w array<int>"), f"reference-hits-{k}")
        shared.destroy()
        hits = made if hits is None else hits.unionByName(made)
    gone = hits.groupBy("doc", "mark").agg(F.flatten(F.collect_list("w")).alias("gone"))
    same = F.col("d.doc").eqNullSafe(F.col("g.doc")) & (F.col("d.mark") == F.col("g.mark"))
    return _cut_out(source.alias("d").join(gone.alias("g"), same, "left").select("d.doc", "d.text", "g.gone"), params)
