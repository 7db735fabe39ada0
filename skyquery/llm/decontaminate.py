"""Benchmark decontamination by templates.

Words lose case and outer punctuation; numbers, units behind numbers, and names (words with a
capital inside a sentence) become typed placeholders, so that a question with other
parameters has the same template. A capital at the start of a sentence, or in a word like O'Neil,
McKay, USA or J., may or may not be a name: windows over such words are hashed in both readings on
both sides. The items' windows of template words become a table of hashes. Each document is read once; those
of its windows that may be in the table, by broadcast bitmaps of fixed size of its words and its hashes, are hash-joined with it. For each document and
item the matched windows are aligned, and their slots must be consistent: a value of the item always stands for
one value in the document, and two values for two, in one alignment and in all that are
taken together. Windows with a slot that breaks this
do not count. A document is contaminated by an item if enough of its windows are left, or if nearly all
of its words stand in the document in aligned runs, so that a replaced word costs that word and not
all windows over it. Items of few words have shorter windows for finding these runs; items of fewer than
``least`` words say too little as templates and are matched whole, with their values.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grown, mapped, slices, stored, WordTable

# Written numbers, and units that may follow a number.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons mph kph hz khz mhz ghz w kw volt volts "
    "percent dollar dollars cent cents euro euros degree degrees".split()
)
_KNOWN_WORDS = frozenset(w.encode() for w in NUMBER_WORDS | UNITS)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*\d|\d")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([a-zµ°%]+)")
_OUTER = re.compile(r"^\W+|\W+$")
PLAIN, NUMBER, NAME, UNIT, MEASURE, NOTHING, LOOSE = range(7)


@dataclass(frozen=True)
class LeakParams:
    """``window``: template words in a window (an item of fewer is one window; of fewer than ``least``, one with its values); ``share``: of an item's windows that must be found.

    ``covered``: of an item's words that must be found in aligned runs of ``run`` words or more, where fewer windows than ``share`` are; ``fixed``: words that a window must keep when capitals of either kind are read as names; ``bits``: of a hash that the bitmap tells apart.
    """

    window: int = 8
    least: int = 5
    share: float = 0.5
    covered: float = 0.8
    run: int = 3
    fixed: int = 3
    bits: int = 24


def describe(word: bytes) -> tuple[int, int, int, bool]:
    """Kind of a word, hash as a template word, hash of its value, and whether it ends a sentence."""
    if word.isalpha() and word.islower() and word not in _KNOWN_WORDS:
        value = xxhash.xxh3_64_intdigest(word)
        return PLAIN, value, value, False
    text = word.decode()
    bare = _OUTER.sub("", text)
    ends = text.rstrip("\"')]}%$&#*|")[-1:] in (".", "!", "?", ":") if text else False
    if not bare:
        return NOTHING, 0, 0, ends
    low = bare.lower()
    value = xxhash.xxh3_64_intdigest(low.encode())
    if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        return NUMBER, value, value, ends
    if (m := _MEASURE.fullmatch(low)) and (m[2] in UNITS or m[2] in "%°"):
        return MEASURE, value, value, ends
    if low in UNITS:
        return UNIT, value, value, ends
    if bare[0].isupper() and bare[1:].islower():
        return NAME, value, value, ends
    if bare[0].isupper():
        return LOOSE, value, value, ends
    return PLAIN, value, value, ends


@dataclass
class Words:
    """Template words of texts: hash, hash of the value, kind of slot (0 for none), whether a word without a slot may be a name, the text of each, and whether windows over it may be wanted."""

    template: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    loose: np.ndarray
    owner: np.ndarray
    known: np.ndarray


class Templates:
    """Texts to template words. ``vocabulary``: a table of the first bits of the hashes of words; other words, but for slots and possible names, are in no window that is wanted."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.table, self.resets, self.vocabulary = WordTable(), 0, vocabulary
        self.kind, self.hash, self.ends, self.known = Grown(np.int8), Grown(np.uint64), Grown(bool), Grown(bool)

    def __call__(self, texts: list[bytes | None]) -> Words:
        ids, counts = self.table.ids(texts)
        if self.table.resets != self.resets:
            self.resets = self.table.resets
            for grown in (self.kind, self.hash, self.ends, self.known):
                grown.clear()
        if fresh := self.table.take_fresh():
            kinds, hashes, _, ends = zip(*map(describe, fresh), strict=True)
            self.kind.extend(np.array(kinds, np.int8))
            self.hash.extend(np.array(hashes, np.uint64))
            self.ends.extend(np.array(ends, bool))
            self.known.extend(np.ones(len(fresh), bool) if self.vocabulary is None else _listed(self.vocabulary, np.array(hashes, np.uint64)))
        owner = np.repeat(np.arange(len(texts)), counts)
        kind, value, ends = self.kind.data[ids], self.hash.data[ids], self.ends.data[ids]
        some = kind != NOTHING
        kind, value, ends, owner, known = kind[some], value[some], ends[some], owner[some], self.known.data[ids][some]
        begins = np.ones(len(kind), bool)
        begins[1:] = owner[1:] != owner[:-1]
        after_end, after_number = begins.copy(), np.zeros(len(kind), bool)
        after_end[1:] |= ends[:-1]
        after_number[1:] = (kind[:-1] == NUMBER) & ~begins[1:]
        slot = np.where((kind == NUMBER) | (kind == MEASURE), kind, 0)
        slot = np.where((kind == NAME) & ~after_end, NAME, slot)
        slot = np.where((kind == UNIT) & after_number, UNIT, slot)
        loose = ((kind == NAME) & after_end) | (kind == LOOSE)
        return Words(np.where(slot > 0, slot.astype(np.uint64), value), value, slot, loose, owner, known)


def _listed(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the first bits of the hashes are in a table of a power of two entries."""
    return table[(h >> np.uint64(65 - len(table).bit_length())).astype(np.int64)]


#: Sets windows of values apart from windows of templates.
_VALUES = np.uint64(0x5851F42D4C957F2D)
_FACTORS = np.random.default_rng(9).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(template: np.ndarray, n: int) -> np.ndarray:
    """A sum with one term for each place in the window, so that another reading of a word changes one term."""
    word, count = _mixed(template), max(0, len(template) - n + 1)
    h = np.full(count, n, np.uint64)
    for i in range(n if count else 0):
        h += word[i : count + i] * _FACTORS[i]
    return h


def readings(words: Words, n: int, params: LeakParams, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows of n words within one text, each with every choice of its loose words as names that leaves ``fixed`` words without a slot.

    Windows of fewer than ``least`` words have one reading, their values. ``keep``: a table of the first bits of hashes; readings of other hashes are left out.
    """
    whole = n < params.least
    first = window_hashes(words.value, n) ^ _VALUES if whole else window_hashes(words.template, n)
    count = len(first)
    inside = words.owner[:count] == words.owner[n - 1 : n - 1 + count]
    listed = lambda h: slice(None) if keep is None else _listed(keep, h)
    before = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    within = lambda flags: (total := before(flags))[n : n + count] - total[:count]
    slot = words.slot > 0
    at = np.flatnonzero(inside & (within(~words.known & ~slot) == 0))
    places, hashes = [at[listed(first[at])]], [first[at][listed(first[at])]]
    # a possible name that no item has as a word can be but a name
    forced = words.loose & ~words.known
    free = words.loose & words.known
    room = n - within(slot | forced) - params.fixed
    some = np.flatnonzero(inside & (within(~words.known & ~slot & ~words.loose) == 0) & (within(words.loose) > 0) & (room >= 0) & (not whole))
    change = (_mixed(np.full(1, NAME, np.uint64)) - _mixed(words.template)) * words.loose
    must = within(forced)
    # texts all in capitals have many readings: few windows at a time
    for i in range(0, len(some), 20_000):
        place = some[i : i + 20_000]
        h, left = first[place], room[place]
        if must[place].any():
            for k in range(n):
                h = h + change[place + k] * forced[place + k] * _FACTORS[k]
            own = must[place] > 0
            p, g = place[own], h[own]
            wanted = listed(g)
            places.append(p[wanted])
            hashes.append(g[wanted])
        for k in range(n):
            other = np.flatnonzero(free[place + k] & (left > 0))
            if not len(other):
                continue
            p, g = place[other], h[other] + change[place[other] + k] * _FACTORS[k]
            wanted = listed(g)
            places.append(p[wanted])
            hashes.append(g[wanted])
            place, h, left = np.concatenate([place, p]), np.concatenate([h, g]), np.concatenate([left, left[other] - 1])
    return np.concatenate(places), np.concatenate(hashes)


def item_lengths(size: int, params: LeakParams) -> tuple[int, ...]:
    """The window lengths of an item of so many template words, the one that is counted first."""
    if size < params.least:
        return (size,) if size else ()
    n = min(params.window, size)
    # of an item with one word replaced a half is left whole: items too short for a window in it have shorter ones besides
    return (n, *({min(n, max(params.least, size // 2))} - {n}))


@dataclass
class Item:
    """An item's words, the length of its counted windows, their hashes as they stand, and how many differ: a window that repeats in the item is found once."""

    words: Words
    length: int
    own: np.ndarray
    total: int

    @staticmethod
    def of(text: bytes, params: LeakParams) -> Item:
        words = Templates()([text])
        n = item_lengths(len(words.template), params)[0]
        own = window_hashes(words.value if n < params.least else words.template, n)
        return Item(words, n, own, len(set(own.tolist())))


def _in_runs(agree: np.ndarray, least: int) -> np.ndarray:
    """The places that lie in runs of at least so many."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], agree, [False]]).astype(np.int8)))
    kept = np.zeros(len(agree), bool)
    for a, b in edge.reshape(-1, 2).tolist():
        kept[a:b] = b - a >= least
    return kept


class _Binding:
    """Alignments whose slots agree: what each value of the item stands for, the item's windows found, and its words in runs."""

    def __init__(self, size: int):
        self.stands: dict[int, int] = {}
        self.back: dict[int, int] = {}
        self.windows: set[int] = set()
        self.covered = np.zeros(size, bool)

    def takes(self, stands: dict[int, int]) -> bool:
        return all(self.stands.get(a, b) == b and self.back.get(b, a) == a for a, b in stands.items())

    def add(self, stands: dict[int, int], windows: set[int], covered: np.ndarray) -> None:
        self.stands.update(stands)
        self.back.update({b: a for a, b in stands.items()})
        self.windows |= windows
        self.covered |= covered


def consistent(item: Item, hits: list[tuple[int, int, int]], words: Words, params: LeakParams) -> tuple[int, float]:
    """Of the hits (position in the item, position in the document, length) the item's windows whose slots agree with the others', and the share of the item's words in aligned runs.

    An occurrence of the item is judged by itself: hits on one diagonal. A slot that contradicts most of its diagonal takes its
    windows away, and the runs of that diagonal do not count. Diagonals count together as far as their slots agree, the fullest first.
    """
    n, own, size, end = item.length, item.words, len(item.words.value), len(words.value)
    named = (own.slot == NAME) | own.loose
    diagonals: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, d, m in hits:
        diagonals[d - at].append((at, m))
    found = []
    for diagonal, some in diagonals.items():
        low, high = max(0, -diagonal), min(size, end - diagonal)
        item_at, doc_at = slice(low, high), slice(low + diagonal, high + diagonal)
        other = words.value[doc_at]
        agree = np.zeros(size, bool)
        agree[item_at] = (own.value[item_at] == other) | ((own.slot[item_at] > 0) & (own.slot[item_at] == words.slot[doc_at])) | (named[item_at] & ((words.slot[doc_at] == NAME) | words.loose[doc_at]))
        agree = _in_runs(agree, min(params.run, n))
        places = np.flatnonzero(agree & ((own.slot > 0) | own.loose)).tolist()
        there: dict[int, Counter] = defaultdict(Counter)
        for p in places:
            there[int(own.value[p])][int(words.value[p + diagonal])] += 1
        stands = {a: c.most_common(1)[0][0] for a, c in there.items()}
        taken = Counter(stands.values())
        stands = {a: b for a, b in stands.items() if taken[b] == 1}
        wrong = {p for p in places if stands.get(int(own.value[p])) != int(words.value[p + diagonal])}
        good = {at for at, m in some if m == n and not any(p in wrong for p in range(at, at + n))}
        # slots outside the good windows bind nothing where the diagonal breaks the rule
        if wrong:
            used = {int(own.value[p]) for p in places if any(p - n < at <= p for at in good)}
            stands = {a: b for a, b in stands.items() if a in used}
        found.append((len(good), int(agree.sum()) * (not wrong), -diagonal, stands, good, agree & (not wrong)))
    bindings: list[_Binding] = []
    for *_, stands, good, agree in sorted(found, key=lambda x: x[:3], reverse=True):
        if not good and not agree.any():
            continue
        taker = next((b for b in bindings if b.takes(stands)), None)
        if taker is None:
            bindings.append(taker := _Binding(size))
        taker.add(stands, good, agree)
    # windows with equal hashes count once
    return max((len({int(item.own[p]) for p in b.windows}) for b in bindings), default=0), max((float(b.covered.mean()) for b in bindings), default=0.0)


def _windows_of_items(items: DataFrame, params: LeakParams) -> DataFrame:
    """(hash, item, at, length) of all readings of the items' windows (item, text), and of their single words with length 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for part, texts in slices(batches):
            words = templates(texts)
            sizes = np.bincount(words.owner, minlength=len(texts))
            lengths = [item_lengths(int(n), params) for n in sizes]
            for m in sorted({m for some in lengths for m in some}):
                place, h = readings(words, m, params)
                wanted = np.array([m in some for some in lengths], bool)[words.owner[place]]
                place, h = place[wanted], h[wanted]
                owner = words.owner[place]
                at = place - np.searchsorted(words.owner, owner)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("item").take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), m, np.int32))], names=["hash", "item", "at", "length"])
            none = pa.array(np.zeros(len(words.value), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(words.value.view(np.int64)), part.column("item").take(pa.array(words.owner)), none, none], names=["hash", "item", "at", "length"])

    return mapped(items, task, f"hash long, item {items.schema['item'].dataType.simpleString()}, at int, length int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(), *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """(doc_id, item_id, windows, found, share) for each document and item that contaminates it.

    Every whole text is compared with every item; ids may be of any type. Null texts and ids of items, and texts and items without a
    word, match nothing; an item of few words is in every text that has these words, with the same values, in a row. ``share`` is of the item's windows, also where it
    is the item's words in aligned runs that decide; of rows that repeat an id each gives its own
    pairs, equal pairs once, and of items that repeat an id each text is an item. An empty benchmark or table gives no rows.
    """
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).alias("text")).dropna().distinct().withColumn("item_mark", F.xxhash64("text"))
    listed = stored(_windows_of_items(items.select(F.struct("item", "item_mark").alias("item"), "text"), params).select("hash", "item.*", "at", "length"), "item-windows")
    lengths = sorted(r[0] for r in listed.select("length").distinct().collect() if r[0])

    def bitmap(rows: DataFrame) -> np.ndarray:
        # at most 2 ** bits numbers, however many items there are
        first = rows.select(F.shiftrightunsigned("hash", 64 - params.bits).cast("int").alias("first")).distinct().toArrow().column(0).to_numpy()
        table = np.zeros(1 << params.bits, bool)
        table[first] = True
        return np.packbits(table)

    shared = docs.sparkSession.sparkContext.broadcast((bitmap(listed.filter("length > 0")), bitmap(listed.filter("length = 0"))))
    source = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text")).filter("text is not null").withColumn("mark", F.xxhash64("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, vocabulary = (np.unpackbits(x).view(bool) for x in shared.value)
        templates = Templates(vocabulary)
        for part, texts in slices(batches):
            words = templates(texts)
            found = [readings(words, n, params, seen) for n in lengths]
            place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
            if not len(place):
                continue
            size = np.repeat(np.array(lengths, np.int32), [len(p) for p, _ in found])
            owner = words.owner[place]
            order = np.argsort(owner, kind="stable")
            which, first = np.unique(owner[order], return_index=True)
            at = (place - np.searchsorted(words.owner, owner))[order].astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array(at), pa.array(size[order]), pa.array(np.concatenate([h for _, h in found])[order].view(np.int64))], names=["place", "length", "hash"])
            some = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(some) for c in ("doc", "mark", "text")), pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), hits)], names=["doc", "mark", "text", "maybe"]
            )

    # written, with their texts, so that documents are read once; a join straight on shuffles, moreover, is one whose hot keys, windows of a common passage, can be split
    maybe = stored(mapped(source, search, f"doc {kind}, mark long, text string, maybe array<struct<place: int, length: int, hash: long>>"), "documents-maybe")
    each = maybe.select("doc", "mark", F.explode("maybe").alias("x")).select("doc", "mark", "x.*")
    hits = each.join(listed.filter("length > 0"), ["hash", "length"]).groupBy("doc", "mark", "item", "item_mark").agg(F.collect_set(F.struct("at", "place", "length")).alias("hits"))
    met = stored(hits, "item-hits").join(items, ["item", "item_mark"])
    by_doc = stored(met.groupBy("doc", "mark").agg(F.collect_list(F.struct("item", F.col("text").alias("item_text"), "hits")).alias("met")), "documents-met")
    same = F.col("d.doc").eqNullSafe(F.col("m.doc")) & (F.col("d.mark") == F.col("m.mark"))
    pairs = maybe.alias("d").join(by_doc.alias("m"), same).select("d.doc", "d.text", "m.met")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, known = Templates(), {}
        for part, texts in slices(batches):
            which, ids, out = [], [], []
            for i, (text, met) in enumerate(zip(texts, part.column("met"), strict=True)):
                words = templates([text])
                entries = met.values
                for j, (content, found) in enumerate(zip(entries.field("item_text").to_pylist(), entries.field("hits").to_pylist(), strict=True)):
                    if content not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[content] = Item.of(content.encode(), params)
                    item = known[content]
                    different, covered = consistent(item, sorted((x["at"], x["place"], x["length"]) for x in found), words, params)
                    share = different / item.total
                    if share >= params.share or covered >= params.covered:
                        which.append(i)
                        ids.append(entries.field("item")[j])
                        out.append((item.total, different, share))
            if out:
                total, n, share = zip(*out, strict=True)
                id_type = part.schema.field("met").type.value_type.field("item").type
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(which, pa.int64())), pa.array([x.as_py() for x in ids], id_type), pa.array(total, pa.int32()), pa.array(n, pa.int32()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "windows", "found", "share"]
                )

    item_kind = items.schema["item"].dataType.simpleString()
    made = mapped(pairs, judge, f"doc_id {kind}, item_id {item_kind}, windows int, found int, share double")
    best = F.max(F.struct("share", "found", "windows")).alias("best")
    return made.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.windows", "best.found", "best.share")


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(), *, id_column: str = "doc_id") -> DataFrame:
    """The documents that no item contaminates, in their columns. Rows with a null id stay."""
    leaks = find_leaks(docs, benchmark, params, id_column=id_column).select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(leaks, id_column, "left_anti")
