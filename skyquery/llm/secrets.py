"""Secret scans, with DataFrame operations only.

Three patterns give the base spans. Besides, runs of key-like characters outside them are compared by
two character Markov models, of random strings and of ordinary identifiers: a run, or a part of it between
separators, whose mean log-likelihood ratio lies above the trained threshold of its length is a span of kind ``random``.
The models are first-order, interpolated with single characters, and trained from labelled samples;
the thresholds come from samples that the models have not seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share

# Kinds of the base, in order, with pattern, the group that is measured and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = ("assign", "access", "hex", "random")
#: Characters that the models know; all of a candidate are among them.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: A part of a candidate between separators.
PART = r"[A-Za-z0-9+]{12,}"
#: The least lengths of the classes that have thresholds of their own.
LENGTHS = (12, 16, 20, 28, 40)
MASK = "[SECRET]"
#: Entries that are added at a time when lengths are summed up.
_STEP = 64


def let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(numbers: Column) -> Column:
    """For each entry the sum of those before it; time grows with the number of entries, not its square."""
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / F.lit(_STEP)).cast("int")), lambda b: _total(F.slice(a, b * _STEP + 1, _STEP)))
    bases = lambda s: F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b)))
    at = lambda a, bs: F.transform(a, lambda _, i: F.element_at(bs, F.floor(i / F.lit(_STEP)).cast("int") + 1) + _total(F.slice(a, F.floor(i / F.lit(_STEP)).cast("int") * _STEP + 1, i % _STEP)))
    return let(numbers, lambda a: let(let(blocks(a), bases), lambda bs: at(a, bs)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The pattern's leftmost non-overlapping matches: structs of start, end (code points), text, and length of the group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    measured = F.regexp_extract_all(text, F.lit(pattern), group) if group else found

    def build(x: Column) -> Column:
        sizes = F.transform(x["m"], lambda m: F.length(m))
        steps = F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), F.concat(F.array(F.lit(0)), sizes), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        steps = F.slice(steps, F.lit(1), F.size(x["m"]))
        starts = F.zip_with(_before(steps), steps, lambda a, b: a + b)
        whole = F.arrays_zip(starts.alias("s"), x["m"].alias("m"), x["n"].alias("n"))
        return F.transform(whole, lambda z: F.struct(z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end"), z["m"].alias("text"), F.length(z["n"]).alias("measured")))

    value = F.struct(gaps.alias("g"), found.alias("m"), measured.alias("n"))
    return let(value, build)


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    kept = F.filter(matches(text, pattern, group), keep)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""
    none = F.array().cast(_SPAN)
    # the condition is a function of one parameter: a second one would be taken for the index
    long_enough = lambda least: lambda x: x["measured"] >= least
    each = [F.when(text.rlike(p), _spans(text, p, k, long_enough(least), group)).otherwise(none) for k, (_, p, group, least) in enumerate(BASE) if k != 2]
    hex_ = r"[0-9a-f]{24,}"  # a run is matched whole, so the least length may stand in the pattern
    each.append(F.when(text.rlike(hex_), _spans(text, hex_, 2, lambda x: F.lit(True))).otherwise(none))
    return F.array_sort(F.concat(*each))


@dataclass(frozen=True)
class SecretModel:
    """``table``: log-likelihood ratio of each pair of characters, random against ordinary, in thousandths; ``thresholds``: of the mean, for each class of LENGTHS."""

    table: tuple[int, ...]
    thresholds: tuple[float, ...]

    def likely(self, text: Column) -> Column:
        """Whether a string of the alphabet, of the least candidate's length or longer, is above its threshold."""
        limit = F.lit(self.thresholds[0])
        for least, t in zip(LENGTHS[1:], self.thresholds[1:], strict=True):
            limit = F.when(F.length(text) >= least, t).otherwise(limit)
        return mean_ratio(text, self.table) > limit


def _codes(text: Column) -> Column:
    place = ["0"] * 128
    for i, c in enumerate(ALPHABET):
        place[ord(c)] = str(i)
    places = F.split(F.lit(",".join(place)), ",").cast("array<int>")
    return F.transform(F.split(text, ""), lambda c: F.element_at(places, F.ascii(c) + 1))


def mean_ratio(text: Column, table: tuple[int, ...]) -> Column:
    """Mean log-likelihood ratio of a string's pairs of neighbours. Only characters of the alphabet may occur, two at least."""
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: F.element_at(ratios, x * len(ALPHABET) + y + 1))
    return let(_codes(text), lambda a: _total(pairs(a)) / F.lit(1000.0) / (F.size(a) - 1))


def random_spans(text: Column, model: SecretModel, base: Column) -> Column:
    """Candidates above the threshold, or else their parts that are, in what the base spans do not cover."""
    span = lambda start, end: F.struct(start.alias("start"), F.lit(3).alias("kind"), end.alias("end"))
    none = F.array().cast(_SPAN)

    def judged(x: Column) -> Column:
        parts = F.filter(matches(x["text"], PART), lambda y: model.likely(y["text"]))
        inner = F.transform(parts, lambda y: span(x["start"] + y["start"], x["start"] + y["end"])).cast(_SPAN)
        return F.when(model.likely(x["text"]), F.array(span(x["start"], x["end"])).cast(_SPAN)).when(x["text"].rlike(r"[/_=-]"), inner).otherwise(none)

    rest = redacted(text, base, " ", stretched=True)
    return F.when(text.rlike(CANDIDATE), F.flatten(let(rest, lambda t: F.transform(matches(t, CANDIDATE), judged)))).otherwise(none)


def labelled_samples(docs: DataFrame, *, documents: int = 400, strings: int = 8000, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Strings (text, random): digests in several alphabets and lengths, and identifiers made of the documents' own plain words.

    ``documents`` bounds the sample of documents (expected number, by a hash of the id),
    ``strings`` the random strings. Words of letters alone are ordinary; they are taken
    single, and two to four of them the way identifiers, constants, types, paths and assignments are
    written. Numbers, dates and rulers are ordinary too.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    letters = F.concat(F.base64(F.unhex(digest)), F.base64(F.unhex(F.sha2(digest, 256))))
    plain = F.regexp_replace(letters, "[^A-Za-z0-9]", "")
    size = (F.lit(12) + F.pmod(F.xxhash64("id"), F.lit(33))).cast("int")
    styles = [F.concat(digest, digest), F.upper(digest), F.regexp_replace(letters, "=", ""), F.translate(F.regexp_replace(letters, "=", ""), "+/", "-_"), plain, plain, F.lower(plain), F.concat(F.lit("AKIA"), F.upper(plain))]
    shape = F.element_at(F.array(*[F.substring(x, F.lit(1), size) for x in styles]), (F.col("id") % len(styles) + 1).cast("int"))
    random = spark.range(strings).select(shape.alias("text"), F.lit(True).alias("random"))
    share = min(1.0, documents / max(1, docs.count()))
    words = docs.filter(hash_share(F.col(id_column), 5) < share).select(F.filter(F.split(text_column, r"[^A-Za-z]+"), lambda w: F.length(w) >= 3).alias("w")).filter("size(w) > 0")
    words = words.select(F.explode(F.transform("w", lambda _, i: F.slice("w", i + 1, F.lit(4)))).alias("w"))
    low, big = (F.transform("w", f) for f in (lambda x: F.lower(x), lambda x: F.initcap(x)))
    two = F.slice(low, F.lit(1), F.lit(2))
    number = F.pmod(F.xxhash64("w"), F.lit(1000)).cast("string")
    written = [
        F.element_at("w", 1), F.array_join(two, "_"), F.array_join("w", "-"), F.concat(F.element_at(low, 1), F.array_join(F.slice(big, F.lit(2), F.lit(3)), "")), F.array_join(big, ""), F.upper(F.array_join("w", "_")), F.array_join(low, "_"),
        F.concat(F.lit("/"), F.array_join(low, "/")), F.array_join(low, ""), F.concat(F.array_join(two, "_"), F.lit("_"), number), F.concat(F.array_join(low, "_"), F.lit("=")), F.concat(F.array_join(two, "/"), F.lit("-"), number), F.upper(F.array_join("w", "")),
    ]
    named = words.select(F.element_at(F.array(*written), (F.pmod(F.xxhash64("w"), F.lit(len(written))) + 1).cast("int")), F.lit(False))
    count = F.abs(F.xxhash64("id")).cast("string")
    figures = spark.range(strings // 8).select(F.when(F.col("id") % 2 == 0, F.substring(count, F.lit(1), (F.lit(12) + F.col("id") % 8).cast("int"))).otherwise(F.concat_ws("-", F.substring(count, 1, 4), F.substring(count, 5, 2), F.substring(count, 7, 2), F.substring(count, 9, 6))), F.lit(False))
    rulers = spark.range(400).select(F.repeat(F.element_at(F.split(F.lit("- = _ / + -= ab x 0"), " "), (F.col("id") % 9 + 1).cast("int")), (F.lit(12) + F.col("id") % 60).cast("int")), F.lit(False))
    return random.union(named).union(figures).union(rulers)


def _rates(counts: list[float], k: int) -> list[float]:
    """Probability of each second character after each first, interpolated with that of the character alone by how many kinds have followed."""
    single = [sum(counts[i * k + j] for i in range(k)) for j in range(k)]
    total = sum(single)
    alone = [(c + 0.5) / (total + 0.5 * k) for c in single]
    out = []
    for i in range(k):
        row = counts[i * k : i * k + k]
        n, kinds = sum(row), sum(c > 0 for c in row)
        out += [(c + kinds * a) / (n + kinds) if n else a for c, a in zip(row, alone, strict=True)]
    return out


def _usable(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("text").rlike(r"^[A-Za-z0-9+/_=-]{2,}$")).withColumn("kept_back", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)


def train(samples: DataFrame) -> SecretModel:
    """Counts pairs of neighbours by label and compares the two models' transition probabilities.

    A quarter of the samples, chosen by a hash of the string, is kept back for the thresholds. A class's
    threshold lies above all but a thousandth of its ordinary strings: a little, or half way to the
    lowest twentieth of the random ones where that is higher. Without samples of
    either label every pair is even, and nothing is found.
    """
    k = len(ALPHABET)
    rows = _usable(samples)
    pair = let(_codes(F.col("text")), lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: x * k + y))
    counted = rows.filter("not kept_back").select("random", F.explode(pair).alias("pair")).groupBy("random", "pair").count().collect()
    counts = {True: [0.0] * (k * k), False: [0.0] * (k * k)}
    for random, p, n in counted:
        counts[bool(random)][p] += n
    rates = {label: _rates(x, k) for label, x in counts.items()}
    table = tuple(round(1000 * math.log(a / b)) for a, b in zip(rates[True], rates[False], strict=True))
    if not any(counts[True]) or not any(counts[False]):
        return SecretModel(table, (math.inf,) * len(LENGTHS))
    scored = rows.filter(F.col("kept_back") & (F.length("text") >= LENGTHS[0])).select("random", _length_class(F.col("text")).alias("c"), mean_ratio(F.col("text"), table).alias("r"))
    found = scored.groupBy("c").agg(F.percentile(F.when(~F.col("random"), F.col("r")), F.lit(0.999)).alias("top"), F.percentile(F.when(F.col("random"), F.col("r")), F.lit(0.05)).alias("low")).collect()
    limits = {r.c: (r.top + 0.05 if r.low is None else max(r.top + 0.05, (r.top + r.low) / 2)) for r in found if r.top is not None}
    # a class without ordinary strings has the highest threshold of the others
    most = max(limits.values(), default=math.inf)
    return SecretModel(table, tuple(float(limits.get(c, most)) for c in range(len(LENGTHS))))


def _length_class(text: Column) -> Column:
    at = F.lit(0)
    for c, least in enumerate(LENGTHS[1:], 1):
        at = F.when(F.length(text) >= least, c).otherwise(at)
    return at


def measured(samples: DataFrame, model: SecretModel) -> DataFrame:
    """(least, random, n, flagged) for each class of lengths and label, over the samples that were kept back: what precision and recall follow from."""
    rows = _usable(samples).filter(F.col("kept_back") & (F.length("text") >= LENGTHS[0]))
    least = F.element_at(F.array(*[F.lit(x) for x in LENGTHS]), _length_class(F.col("text")) + 1)
    return rows.groupBy(least.alias("least"), "random").agg(F.count(F.lit(1)).alias("n"), F.count_if(model.likely(F.col("text"))).alias("flagged"))


def scan(docs: DataFrame, model: SecretModel, *, text_column: str = "text", base_column: str = "base_spans", spans_column: str = "secret_spans") -> DataFrame:
    """The rows with ``base_spans`` and ``secret_spans``: arrays of (start, kind, end) by start, then kind; code points, end exclusive.

    Null and empty texts have none. Rows are independent: repeated rows get equal results, an empty table an empty one. Input columns of
    the two names are replaced; other names can be given for the results.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    found = docs.withColumn(base_column, base_spans(text))
    base = F.col(f"`{base_column}`")
    return found.withColumn(spans_column, F.array_sort(F.concat(base, random_spans(text, model, base))))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = MASK, *, stretched: bool = False) -> Column:
    """The text with every span, or union of overlapping ones, replaced by the mask; ``stretched``: by a mask for each character."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        first = F.greatest(a["at"], s["start"])
        hidden = F.repeat(F.lit(mask), s["end"] - first) if stretched else F.when(s["start"] >= a["at"], F.lit(mask)).otherwise("")
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, first - a["at"]), hidden)
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["end"] > a["at"], new).otherwise(a["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, put, rest)).otherwise(text)
