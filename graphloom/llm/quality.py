"""Quality rules: counts of words, symbols and repetition, and n-gram perplexity within bands of each language.

The model is a 4-gram modified Kneser-Ney model over characters (units of UTF-16), one for each language, a null one included.
Spark counts the 4-grams of all whole texts and builds every order by joins (``kneser_ney``), into a table that grows with the
corpus. It is looked up in shards of at most ``SHARD`` grams: a language's documents are scanned once for each of its shards,
languages that fit together share one, and a worker holds one shard as sorted arrays. Each gram is in one shard, so the sums of
the shards are a document's log-probability.

A document is rejected if its mean negative log-probability, by the model or by the frequency of single characters, is outside
its language's band: median -/+ ``WIDTH`` times the median absolute deviation, over all documents of the language that pass the counts,
wider for short texts by sqrt(SHORT / characters). The model finds characters in an unusual order; capitals, symbol tails and
tables that repeat are predictable in their own context, but made of rare characters. The median is
a language's own at any size; the deviation is drawn towards that of all documents by a weight of ``PRIOR`` documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches
from .textkit import SPACE, U, Words, mix, slices

SYMBOLS = b"#*$%&|<>"
ORDER = 4
WIDTH, SHORT, PRIOR, LEAST_DEVIATION = 5.0, 1000.0, 20, 0.005
BIN = 0.001
#: Symbols: four of them are a 64-bit number.
A = 1 << 16
#: Grams of a shard: a worker holds 12 bytes of each.
SHARD = 2_000_000
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
_PAD = "\n" * (ORDER - 1)


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of the texts, as a number, and where each text's begin. Texts begin after line ends."""
    units = [np.frombuffer((_PAD + t.decode("utf-8", "replace")).encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    lengths = np.fromiter(map(len, units), np.int64, len(units)) - (ORDER - 1)
    raw = np.concatenate(units).astype(np.int64) if units else np.zeros(0, np.int64)
    gram = np.zeros(max(len(raw) - ORDER + 1, 0), np.int64)
    for j in range(ORDER):
        gram = (gram << 16) | raw[j : j + len(gram)]
    inner = np.ones(len(gram) + ORDER - 1, bool)
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    for j in range(1, ORDER):  # these end in the padding of the next text
        inner[starts[1:] - j] = False
    gram = gram[inner[: len(gram)]] if len(texts) else gram
    return gram, np.concatenate([[0], np.cumsum(lengths)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[int]]]:
    rows: dict = {}
    for i, x in enumerate(batch.column("lang").to_pylist()):
        rows.setdefault(x, []).append(i)
    yield from rows.items()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}

    def rows(lang):
        gram, n = _merged(held.pop(lang))
        for i in range(0, len(gram), 1 << 16):
            k = len(gram[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(gram[i : i + k]), pa.array(n[i : i + k])], ["lang", "gram", "n"])

    for batch in batches:
        texts = batch.column("t").cast(pa.binary()).to_pylist()
        for lang, at in _by_lang(batch):
            for a, b in slices([texts[i] for i in at], 4 << 20):
                held.setdefault(lang, []).append(np.unique(codes([texts[i] for i in at[a:b]])[0], return_counts=True))
            if len(held[lang]) > 8:
                held[lang] = [_merged(held[lang])]
        while sum(len(x) for v in held.values() for x, _ in v) > SHARD:
            yield from rows(max(held, key=lambda k: sum(len(x) for x, _ in held[k])))
    for lang in list(held):
        yield from rows(lang)


def kneser_ney(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, gram, logp) of the 4-grams (lang, gram, n): as ``Model`` has them, for each language, by joins."""
    levels = [counts.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("l"), "gram", "n")]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].groupBy("l", F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(scratch.table(shorter, f"level{k}"))
    lower = None
    for k, level in enumerate(reversed(levels), 1):
        times = lambda c: F.greatest(F.count_if(F.col("n") == c), F.lit(1)).cast("double")
        ones = level.groupBy(F.col("l").alias("dl")).agg(*[times(c).alias(f"n{c}") for c in (1, 2, 3, 4)])
        y = F.expr("n1 / (n1 + 2 * n2)")
        cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(c - 0.01), c - (c + 1) * y * F.col(f"n{c + 1}") / F.col(f"n{c}")))
        ones = ones.select("dl", *[cut(c).alias(f"d{c}") for c in (1, 2, 3)])
        ones = scratch.table(ones, f"cuts{k}")  # a row for each language
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = level.join(ones, F.col("l") == F.col("dl")).select("l", "gram", "n", off.alias("off"), F.shiftright("gram", 16).alias("context"))
        context = own.groupBy(F.col("l").alias("cl"), F.col("context").alias("c")).agg(F.sum("n").alias("total"), F.sum("off").alias("spare"))
        own = own.join(context, (F.col("l") == F.col("cl")) & (F.col("context") == F.col("c")))
        below = F.lit(1 / A)
        if lower is not None:
            own = own.join(lower.select(F.col("l").alias("bl"), F.col("gram").alias("b"), F.col("p").alias("below")), (F.col("l") == F.col("bl")) & (F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1) == F.col("b")))
            below = F.col("below")
        lower = scratch.table(own.select("l", "gram", ((F.col("n") - F.col("off") + F.col("spare") * below) / F.col("total")).alias("p")), f"p{k}")
    return lower.select(F.when(F.col("l") != "", F.substring("l", 2, 1 << 30)).alias("lang"), "gram", F.log("p").cast("float").alias("logp"))


def shards(sizes: list[tuple[str | None, int]]) -> list[tuple[list, int, int]]:
    """(languages, part, parts): a language of over SHARD grams is in several parts, the others share shards."""
    out, some, held = [], [], 0
    for lang, n in sorted(sizes, key=lambda x: (x[0] is not None, x[0] or "")):
        parts = -(-n // SHARD)
        if parts > 1:
            out += [([lang], k, parts) for k in range(parts)]
            continue
        if some and held + n > SHARD:
            out.append((some, 0, 1))
            some, held = [], 0
        some, held = [*some, lang], held + n
    return [*out, (some, 0, 1)] if some else out


def _of(langs: list) -> Column:
    named = F.coalesce(F.col("lang").isin([x for x in langs if x is not None]), F.lit(False))
    return named | F.col("lang").isNull() if None in langs else named


class Model:
    """Interpolated modified Kneser-Ney in back-off form, in memory: for each order sorted hashes, log-probabilities and weights.
    The plain version of ``kneser_ney``."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.keys, self.logp, self.back_keys, self.back = [], [], [], []
        levels = [(grams, counts)]
        for k in range(ORDER - 1, 0, -1):  # in how many contexts a shorter gram is seen
            shorter, n = np.unique(levels[-1][0] % A**k, return_counts=True)
            levels.append((shorter, n))
        lower = None
        for k, (gram, n) in enumerate(reversed(levels), 1):
            ones = [max(int((n == c).sum()), 1) for c in (1, 2, 3, 4)]
            y = ones[0] / (ones[0] + 2 * ones[1])
            cut = np.clip([0, 1 - 2 * y * ones[1] / ones[0], 2 - 3 * y * ones[2] / ones[1], 3 - 4 * y * ones[3] / ones[2]], 0, [0, 0.99, 1.99, 2.99])
            context, at = np.unique(gram // A, return_inverse=True)
            off = cut[np.minimum(n, 3)]
            total, spare = np.bincount(at, n), np.bincount(at, off)
            below = np.full(len(gram), 1 / A) if lower is None else lower(gram % A ** (k - 1))
            p = (n - off) / total[at] + spare[at] / total[at] * below
            self._add(k, gram, np.log(p), context, np.log(np.maximum(spare / total, 1e-9)))
            lower = lambda g, k=k: np.exp(self._find(g, k))

    def _add(self, k: int, gram: np.ndarray, logp: np.ndarray, context: np.ndarray, back: np.ndarray) -> None:
        for keys, values, x, v in ((self.keys, self.logp, gram, logp), (self.back_keys, self.back, context, back)):
            hashed = mix(x.astype(U), k)
            by = np.argsort(hashed)
            keys.append(hashed[by])
            values.append(v[by].astype(np.float32))

    def _find(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Log-probability of the last symbol of each k-gram."""
        if k == 0:
            return np.full(len(gram), -np.log(A))
        out = np.zeros(len(gram))
        seen = _look(self.keys[k - 1], gram, k)
        hit = seen >= 0
        out[hit] = self.logp[k - 1][seen[hit]]
        if not hit.all():
            rest = gram[~hit]
            context = _look(self.back_keys[k - 1], rest // A, k)
            weight = np.where(context >= 0, self.back[k - 1][np.maximum(context, 0)], 0.0)
            out[~hit] = weight + self._find(rest % A ** (k - 1), k - 1)
        return out

    def score(self, gram: np.ndarray) -> np.ndarray:
        if not len(self.keys[-1]):
            return np.zeros(len(gram))
        new, at = np.unique(gram, return_inverse=True)
        return self._find(new, ORDER)[at]


def _look(keys: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Place of each hashed value in the sorted hashes, or -1."""
    hashed = mix(x.astype(U), k)
    at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    return np.where(keys[at] == hashed, at, -1)


def _repeats(words: Words, i: int) -> int:
    """Words of text i in three-word windows that it has twice or more."""
    first, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
    if n < 4:
        return 0
    _, where, times = np.unique(words.grams3[first : first + n - 2], return_inverse=True, return_counts=True)
    again = times[where] > 1
    cover = np.zeros(n, bool)
    for j in range(3):
        cover[j : j + n - 2] |= again
    return int(cover.sum())


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, n_units long, total double, plain double, same long"


def _features(shard):
    """The counts of each row, and the sum of the log-probabilities of those of its grams that are in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shard.value
        for batch in batches:
            all_texts, rows = batch.column("t").cast(pa.binary()).to_pylist(), [None] * batch.num_rows
            for lang, where in _by_lang(batch):
                keys, logp, single = own[lang]
                texts = [all_texts[i] for i in where]
                for a, b in slices(texts):
                    words = Words(texts[a:b])
                    words.grams3 = words.grams(3)
                    inner = words.offsets
                    sums = lambda x: np.concatenate([[0], np.cumsum(x)])[inner]
                    chars = np.diff(sums(~SPACE[words.data] & ((words.data & 0xC0) != 0x80)))
                    symbols = np.diff(sums(IS_SYMBOL[words.data]))
                    gram, at = codes(texts[a:b])
                    score = np.zeros(len(gram) + 1)
                    if len(keys):
                        new, back = np.unique(gram, return_inverse=True)
                        seen = np.minimum(np.searchsorted(keys, new), len(keys) - 1)
                        np.cumsum(np.where(keys[seen] == new, logp[seen], np.float32(0)).astype(np.float64)[back], out=score[1:])
                    total, units = np.diff(score[at]), np.diff(at)
                    plain = np.diff(np.concatenate([[0], np.cumsum(single[gram & (A - 1)])])[at])
                    for i in range(b - a):
                        t = texts[a + i]
                        rows[where[a + i]] = (int(words.first[i + 1] - words.first[i]), int(chars[i]), int(symbols[i]), _duplicate_lines(t), _repeats(words, i), len(t), int(units[i]), float(total[i]), float(plain[i]))
            columns = [pa.array([r[k] for r in rows], pa.float64() if k > 6 else pa.int64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *columns, batch.column("same")], [f.split()[0] for f in FEATURES.split(", ")])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for lang, at in _by_lang(batch):
            held.setdefault(lang, []).append([batch.column(c).to_numpy()[at] for c in ("gram", "logp")])
    for lang, parts in held.items():
        gram, logp = (np.concatenate(x).tobytes() for x in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([gram], pa.binary()), pa.array([logp], pa.binary())], ["lang", "gram", "logp"])


def _shard(model: DataFrame, singles: DataFrame, langs: list, part: int, parts: int) -> dict:
    """For each language sorted grams and their log-probabilities (SHARD at most, or about as many where a language has parts),
    and log-frequencies of single characters. They come to the driver as arrays, not rows."""
    own = model.where(_of(langs) & (F.pmod(F.xxhash64("gram"), F.lit(parts)) == part))
    out = {x: ([np.zeros(0, np.int64)], [np.zeros(0, np.float32)], np.zeros(A)) for x in langs}
    for lang, gram, logp in own.mapInArrow(_packed, "lang string, gram binary, logp binary").toLocalIterator():
        out[lang][0].append(np.frombuffer(gram, np.int64))
        out[lang][1].append(np.frombuffer(logp, np.float32))
    for lang, gram, n in singles.where(_of(langs)).collect():  # at most A rows a language
        out[lang][2][gram] = n
    for x, (gram, logp, n) in out.items():
        gram, logp = np.concatenate(gram), np.concatenate(logp)
        by, n = np.argsort(gram), n / max(n.sum(), 1)
        out[x] = gram[by], logp[by], np.log(n, out=np.zeros(A), where=n > 0)
    return out


def scored(own: DataFrame, scratch: Scratch) -> DataFrame:
    """FEATURES, ``surprise`` and ``rarity`` (by the model and by single characters, for each character) of the rows (doc_id, lang, t) by the model of all of them."""
    spark = own.sparkSession
    counts = scratch.table(own.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    model = scratch.table(kneser_ney(counts, scratch), "model")
    scratch.drop(*[f"{x}{k}" for x in ("level", "p") for k in range(1, ORDER + 1)])
    singles = scratch.table(counts.groupBy("lang", F.col("gram").bitwiseAND(A - 1).alias("gram")).agg(F.sum("n").alias("n")), "singles")
    sizes = dict(model.groupBy("lang").count().collect())  # a row for each language
    rows, keyed = None, own.withColumn("same", F.xxhash64("t"))
    plan = shards(list(sizes.items()))
    for k, (langs, part, parts) in enumerate(plan):
        shard = spark.sparkContext.broadcast(_shard(model, singles, langs, part, parts))  # about SHARD grams at most
        found = scratch.table(keyed.where(_of(langs)).mapInArrow(_features(shard), FEATURES).withColumn("parts", F.lit(parts)), f"features{k}")
        shard.unpersist()
        rows = found if rows is None else rows.unionByName(found)
    # Rows of languages without any text have no characters to score.
    none = {x: (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(A)) for x, in own.where(~_of(list(sizes))).select("lang").distinct().collect()}
    if none or rows is None:
        rest = keyed.where(~_of(list(sizes))).mapInArrow(_features(spark.sparkContext.broadcast(none)), FEATURES).withColumn("parts", F.lit(1))
        rows = rest if rows is None else rows.unionByName(rest)
    if any(parts > 1 for _, _, parts in plan):  # a row's sums over the shards; repeated rows stay
        keys = [f.split()[0] for f in FEATURES.split(", ") if f.split()[0] not in ("total", "plain")]
        several = rows.where("parts > 1").groupBy(*keys).agg(F.sum("total").alias("total"), F.max("plain").alias("plain"), (F.count(F.lit(1)) / F.first("parts")).cast("int").alias("n"))
        several = several.withColumn("total", F.col("total") / F.col("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).drop("copy", "n")
        rows = rows.where("parts = 1").drop("parts").unionByName(several)
    each = lambda c: -F.col(c) / F.greatest("n_units", F.lit(1))
    return rows.withColumn("surprise", each("total")).withColumn("rarity", each("plain"))


def _middle(hist: DataFrame, value: str, name: str, keys: list[str]) -> DataFrame:
    """Weighted lower median of ``value`` (weight n) for each key, from binned counts."""
    part = Window.partitionBy(*keys)
    run = hist.withColumn("upto", F.sum("n").over(part.orderBy(value))).withColumn("all", F.sum("n").over(part))
    return run.where(F.col("upto") * 2 >= F.col("all")).groupBy(*keys).agg(F.min(value).alias(name), F.first("all").alias("docs"))


def failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def bands(features: DataFrame, value: str) -> DataFrame:
    """(b_lang, centre, spread) of a measure of each language, null included; from counts in bins of BIN.

    The centre is the language's own at any size. The spread is the mean of its own, weighted by its documents, and of the
    deviation of all documents from their own languages' centres, weighted by PRIOR.
    """
    base = features.where(~failed()).groupBy(F.col("lang").alias("b_lang"), F.round(F.col(value) / BIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    keys = ["b_lang", "none"]
    hist = base.select(F.coalesce("b_lang", F.lit("")).alias("b_lang"), F.col("b_lang").isNull().alias("none"), "bin", "n")
    centre = _middle(hist, "bin", "centre", keys)
    apart = hist.join(centre, keys).select(*keys, F.abs(F.col("bin") - F.col("centre")).alias("apart"), "n").groupBy(*keys, "apart").agg(F.sum("n").alias("n"))
    pooled = _middle(apart.groupBy(F.lit(0).alias("all_langs"), "apart").agg(F.sum("n").alias("n")), "apart", "prior", ["all_langs"]).select("prior")
    own = centre.join(_middle(apart, "apart", "spread", keys).drop("docs"), keys).join(F.broadcast(pooled))  # one row
    spread = (F.col("docs") * F.col("spread") + PRIOR * F.col("prior")) / (F.col("docs") + PRIOR)
    return own.select(F.when(~F.col("none"), F.col("b_lang")).alias("b_lang"), (F.col("centre") * BIN).alias("centre"), (spread * BIN).alias("spread"))


def quality_report(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The counts, ``base_failed``, ``perplexity`` (for each character) and ``kept`` of each row of ``docs``.

    Null text has no words. base_failed: under 50 words, or more than half of the words in three-word windows that the text
    repeats. kept: false for those, else whether both measures are in the bands of the language; a null language is one of its
    own. Repeated rows stay. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "quality")
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[lang].alias("lang"), F.coalesce(docs[text], F.lit("")).alias("t"))
    features = scratch.table(scored(own, scratch), "features")
    inside, joined = F.lit(True), features
    wider = F.greatest(F.lit(1.0), F.sqrt(F.lit(SHORT) / F.greatest(F.col("n_units"), F.lit(1))))
    for value in ("surprise", "rarity"):
        band = scratch.table(bands(features, value), f"bands-{value}").toDF(f"l_{value}", f"c_{value}", f"s_{value}")
        joined = joined.join(band, F.col("lang").eqNullSafe(F.col(f"l_{value}")), "left")
        width = F.lit(WIDTH) * F.greatest(F.col(f"s_{value}"), F.lit(LEAST_DEVIATION)) * wider
        inside = inside & F.coalesce(F.abs(F.col(value) - F.col(f"c_{value}")) <= width, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & inside).alias("kept"), F.exp("surprise").alias("perplexity"))


def op5_quality(docs: DataFrame) -> DataFrame:
    return quality_report(docs).drop("perplexity")
