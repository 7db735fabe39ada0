"""Language identification: interpolated Kneser-Ney character models, one for each language.

Words (runs of letters, in lower case, with a boundary on both sides) are predicted
character by character from up to ``order - 1`` characters before, inside the word. The
distinct character strings of a bounded sample of labelled documents are counted in Spark;
the driver turns the counts into interpolated Kneser-Ney probabilities, a block of a few languages at a
time. For each order a block's are kept in arrays sorted by a 64-bit hash of the string, with a column of log-probabilities
for each language; a string that a language lacks has its backed-off probability, so that
one search serves all languages of the block. What is held grows with the languages, not with their square.

A document's language is that of the lowest cross-entropy per character. Scores are
calibrated on labelled documents apart from the fitted ones, which also give each language
the cross-entropy beyond which a text is rejected as none of them.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grown, hash_share, mapped, slices, spare_name, stored, WordTable

EDGE = " "
#: Rows of three values each that may be broadcast.
MOST_BROADCAST = 100_000
UNKNOWN = "und"
_MULTIPLY = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class LanguageParams:
    """``sample``: labelled documents of each language that are fitted to (expected number); ``calibration``: further ones for the scores; ``block``: languages that share arrays."""

    order: int = 5
    sample: int = 600
    calibration: int = 150
    seed: int = 11
    rejected: float = 0.002
    block: int = 8


def letter_runs(word: bytes) -> list[str]:
    """Runs of letters in a word, in lower case."""
    text = word.decode().lower()
    if text.isalpha():
        return [text]
    return "".join(c if c.isalpha() else EDGE for c in text).split()


def _strings(word: str, order: int) -> Iterator[str]:
    """For each predicted character the longest string of at most ``order`` that ends with it."""
    padded = EDGE + word + EDGE
    for end in range(2, len(padded) + 1):
        yield padded[max(0, end - order) : end]


def count_strings(docs: DataFrame, params: LanguageParams) -> DataFrame:
    """(lang, string, n) over the rows (lang, text): counted in each task, then summed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for part, texts in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                words[lang].update((text or b"").split())
        for lang, counter in words.items():
            found: Counter = Counter()
            for word, n in counter.items():
                for run in letter_runs(word):
                    for s in _strings(run, params.order):
                        found[s] += n
            keys = list(found)
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "string": some, "n": [found[s] for s in some]})

    rows = mapped(docs.select("lang", "text"), task, "lang string, string string, n long")
    return rows.groupBy("lang", "string").agg(F.sum("n").alias("n"))


def _levels(counts: dict[str, int], order: int) -> list[dict[str, int]]:
    """Counts of each order: as counted for strings that cannot be longer, else the number of distinct strings one longer."""
    levels: list[dict[str, int]] = [{} for _ in range(order + 1)]
    for s, n in counts.items():
        levels[len(s)][s] = n
    for k in range(order, 1, -1):
        kinds = Counter(s[1:] for s in levels[k])
        for s, n in kinds.items():
            if k - 1 == 1 or s[0] != EDGE:
                levels[k - 1][s] = n
            else:
                levels[k - 1].setdefault(s, n)
    return levels


class KneserNey:
    """One language: probability of each string's last character given those before it."""

    def __init__(self, counts: dict[str, int], order: int, characters: int):
        self.order, self.base = order, 1.0 / max(1, characters)
        self.p: list[dict[str, float]] = [{} for _ in range(order + 1)]
        self.back: list[dict[str, float]] = [{} for _ in range(order + 1)]
        for k, level in enumerate(_levels(counts, order)):
            if not k or not level:
                continue
            seen = Counter(level.values())
            discount = min(0.95, seen[1] / (seen[1] + 2 * seen[2])) if seen[1] else 0.5
            discount = max(discount, 0.05)
            total, kinds = Counter(), Counter()
            for s, n in level.items():
                total[s[:-1]] += n
                kinds[s[:-1]] += 1
            self.back[k] = {c: discount * kinds[c] / t for c, t in total.items()}
            for s, n in level.items():
                c = s[:-1]
                self.p[k][s] = max(n - discount, 0.0) / total[c] + self.back[k][c] * self.of(s[1:])

    def of(self, s: str) -> float:
        """Interpolated probability of the last character, whether the string was seen or not."""
        scale = 1.0
        while s:
            k = len(s)
            if (p := self.p[k].get(s)) is not None:
                return scale * p
            scale *= self.back[k].get(s[:-1], 1.0)
            s = s[1:]
        return scale * self.base


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n codes."""
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * _MULTIPLY
        h ^= h >> np.uint64(29)
    return h


def _hash_all(strings: list[str], n: int) -> np.ndarray:
    if not strings:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.uint64)
    return _hash(codes, n)[::n] if n else np.zeros(len(strings), np.uint64)


@dataclass
class LanguageBlock:
    """Sorted hashes and log-probabilities (a column for each language) by order; the same of the contexts' back-off weights."""

    languages: list[str]
    order: int
    strings: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the log-probability in each language of the block, and the number of characters predicted."""
        runs = [letter_runs(w) for w in words]
        count = np.fromiter((sum(len(r) + 1 for r in rs) for rs in runs), np.int64, len(runs))
        total = np.zeros((len(words), len(self.languages)))
        flat = [EDGE + r + EDGE for rs in runs for r in rs]
        if not flat or not self.languages:
            return total, count
        owner = np.repeat(np.arange(len(runs)), np.fromiter(map(len, runs), np.int64, len(runs)))
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        codes = np.frombuffer("".join(flat).encode("utf-32-le"), "<u4").astype(np.uint64)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(codes))
        have = np.minimum(at - begin + 1, self.order)
        logp = np.zeros((len(codes), len(self.languages)))
        open_ = have >= 2
        word = np.repeat(owner, sizes)
        for n in range(self.order, 0, -1):
            rows = np.flatnonzero(open_ & (have >= n))
            if not len(rows):
                continue
            key = _hash(codes, n)[rows - n + 1] if n <= len(codes) else np.zeros(0, np.uint64)
            keys, values = self.strings[n]
            found, where = _find(keys, key)
            logp[rows[found]] += values[where[found]]
            open_[rows[found]] = False
            rest = rows[~found]
            if not len(rest):
                continue
            if n == 1:
                logp[rest] += self.floor
            elif n > 1:
                keys, values = self.contexts[n]
                found, where = _find(keys, _hash(codes, n - 1)[rest - n + 1])
                logp[rest[found]] += values[where[found]]
        scored = np.flatnonzero(have >= 2)
        for j in range(len(self.languages)):
            total[:, j] = np.bincount(word[scored], weights=logp[scored, j], minlength=len(words))
        return total, count


@dataclass
class LanguageModel:
    blocks: list[LanguageBlock]
    sharpness: float = 20.0
    limits: np.ndarray | None = None

    @property
    def languages(self) -> list[str]:
        return [lang for block in self.blocks for lang in block.languages]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the log-probability in each language, and the number of characters predicted."""
        found = [block.words(words) for block in self.blocks] or [LanguageBlock([], 1, [], [], np.zeros(0)).words(words)]
        return np.concatenate([logp for logp, _ in found], 1), found[0][1]

    def posterior(self, entropy: np.ndarray) -> np.ndarray:
        z = -self.sharpness * (entropy - entropy.min(1, keepdims=True))
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[where] == wanted, where


def build(counts: dict[str, dict[str, int]], order: int, characters: int) -> LanguageBlock:
    """The models of some languages from their strings' counts; ``characters``: how many there are in all languages."""
    languages = sorted(counts)
    models = [KneserNey(counts[lang], order, characters) for lang in languages]
    strings, contexts = [(np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32))], [(np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32))]
    for k in range(1, order + 1):
        for out, every, value, n in (
            (strings, {s for m in models for s in m.p[k]}, lambda m, s: m.of(s), k),
            (contexts, {c for m in models for c in m.back[k]}, lambda m, c, k=k: m.back[k].get(c, 1.0), k - 1),
        ):
            listed = list(every)
            hashes = _hash_all(listed, n)
            values = np.empty((len(listed), len(languages)), np.float32)
            for j, m in enumerate(models):
                values[:, j] = np.log(np.fromiter((value(m, s) for s in listed), np.float64, len(listed)))
            by = np.argsort(hashes, kind="stable")
            out.append((hashes[by], values[by]))
    empty = np.array([math.log(m.back[1].get("", 1.0) * m.base) for m in models])
    return LanguageBlock(languages, order, strings, contexts, empty)


class Identifier:
    """Cross-entropies of texts in a worker; keeps each distinct word's log-probabilities."""

    def __init__(self, model: LanguageModel):
        self.model, self.table, self.resets = model, WordTable(), 0
        self.logp, self.count = Grown(np.float32, max(1, len(model.languages))), Grown(np.int64)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) in each language, and the number of characters predicted: 0 without letters."""
        ids, counts = self.table.ids(texts)
        if self.table.resets != self.resets:
            self.resets = self.table.resets
            self.logp.clear()
            self.count.clear()
        if fresh := self.table.take_fresh():
            for i in range(0, len(fresh), 20_000):
                logp, count = self.model.words(fresh[i : i + 20_000])
                self.logp.extend(logp.astype(np.float32) if logp.shape[1] else np.zeros((len(count), 1), np.float32))
                self.count.extend(count)
        doc = np.repeat(np.arange(len(texts)), counts)
        n = np.bincount(doc, weights=self.count.data[ids], minlength=len(texts)).astype(np.int64)
        total = np.stack([np.bincount(doc, weights=self.logp.data[ids, j], minlength=len(texts)) for j in range(len(self.model.languages))], 1) if self.model.languages else np.zeros((len(texts), 0))
        return -total / np.maximum(n, 1)[:, None], n


def fit(docs: DataFrame, params: LanguageParams = LanguageParams(), *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """Fits to about ``sample`` documents of each language, chosen by a hash of their ids; calibrates on about ``calibration`` others.

    Rows with a null language or text are left out; null ids are never chosen. With no
    labelled rows the model knows no language and answers ``und``.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).dropna()
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([])
    # the calibration documents have the highest hashes, the fitted ones the lowest, a third of all at least
    shares = [(lang, min(params.sample / n, 0.75), max(1 - params.calibration / n, 0.75)) for lang, n in sizes.items()]
    limits = docs.sparkSession.createDataFrame(shares, "lang string, low double, high double")
    chosen = rows.withColumn("_h", hash_share(F.col("_id"), params.seed)).join(F.broadcast(limits) if len(shares) <= MOST_BROADCAST else limits, "lang")
    strings = stored(count_strings(chosen.filter("_h < low"), params), "language-strings")
    characters = strings.select(F.expr("right(string, 1)").alias("c")).distinct().count() + 1
    blocks, languages = [], sorted(sizes)
    for i in range(0, len(languages), params.block):
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        # as much as the samples of a block's languages hold
        for lang, s, n in zip(*strings.filter(F.col("lang").isin(languages[i : i + params.block])).toArrow().to_pydict().values(), strict=True):
            counts[lang][s] = n
        if counts:
            blocks.append(build(counts, params.order, characters))
    model = LanguageModel(blocks)
    if blocks:
        _calibrate(model, chosen.filter("_h >= high"), params)
    return model


def _entropies(rows: DataFrame, keep: list[str], model: LanguageModel) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = rows.select(*keep).withColumns({"_h": F.array(F.lit(0.0)), "_n": F.lit(0).cast("long")}).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(pickle.loads(shared.value))
        for part, texts in slices(batches, "_text"):
            h, n = identify(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], names=[*keep, "_h", "_n"])

    return mapped(rows.select(*keep, "_text"), task, schema)


def _calibrate(model: LanguageModel, rows: DataFrame, params: LanguageParams) -> None:
    got = _entropies(rows.withColumnRenamed("text", "_text").withColumnRenamed("_h", "_share"), ["lang"], model).filter("_n > 0").toArrow()
    index = {lang: i for i, lang in enumerate(model.languages)}
    pairs = [(index[lang], h) for lang, h in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) if lang in index]
    if not pairs:
        return
    truth, h = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def loss(sharpness: float) -> float:
        model.sharpness = sharpness
        return -np.log(np.maximum(model.posterior(h)[np.arange(len(h)), truth], 1e-9)).mean()

    model.sharpness = min((1.0, 2.0, 4.0, 8.0, 12.0, 16.0, 24.0), key=loss)
    own = h[np.arange(len(h)), truth]
    spread = {i: own[truth == i] for i in range(len(model.languages))}
    model.limits = np.array([np.quantile(x, 1 - params.rejected) + 3 * x.std() + 0.05 if len(x) else np.inf for x in spread.values()])


def identify(docs: DataFrame, model: LanguageModel, *, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with lang_pred, score (the calibrated probability), cross_entropy and rejected.

    Every whole text is scored. Null texts and texts without a letter are ``und`` with score
    0 and rejected. Other texts always get the best learned language; ``rejected`` says that
    its cross-entropy lies beyond what that language's own documents have. Input columns of these names are replaced.
    """
    added = ("lang_pred", "score", "cross_entropy", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = spare_name(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_column).alias(source))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "cross_entropy": F.lit(0.0), "rejected": F.lit(True)}).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        entropies, names = Identifier(m), np.array([*m.languages, UNKNOWN], object)
        limits = m.limits if m.limits is not None else np.full(len(m.languages), np.inf)
        for part, texts in slices(batches, source):
            h, n = entropies(texts)
            known = (n > 0) & bool(m.languages)
            best = h.argmin(1) if m.languages else np.zeros(len(n), np.int64)
            score = np.where(known, m.posterior(h).max(1), 0.0) if m.languages else np.zeros(len(n))
            low = np.where(known, h[np.arange(len(n)), best], 0.0) if m.languages else np.zeros(len(n))
            far = ~known | (low > (limits[best] if m.languages else 0))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(keep))), pa.array(names[np.where(known, best, -1)].tolist(), pa.string()), pa.array(score), pa.array(low), pa.array(far)], names=[*keep, *added]
            )

    return mapped(rows, task, schema)
