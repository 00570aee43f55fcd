"""Toxicity by maximum-scoring segments.

1. Token log-odds. Features are words (runs of letters, A-Z folded) and their first five to eight bytes. From labelled training
   documents, the log-odds of a feature in toxic against other documents get an informative Dirichlet prior in
   proportion to its frequency in both, and half a document more; features with a z-score of at least ``Z_LEAST`` are kept with their log-odds.
2. Every other token costs ``DRIFT``. A linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text.
3. Extreme-value calibration. Under the tokens of documents that are not toxic, the expected number of segments of score
   s or more in n tokens is K n exp(-lambda s). lambda solves E[exp(lambda s)] = 1 over the scores of their tokens, in steps of
   ``STEP``. K is the likeliest for the best score m of each document: documents with a segment, divided by the sum of
   n exp(-lambda m) over all (m is 0 without a segment). A segment is significant if fewer than ``E_MOST`` such are expected in
   a text of its length. A logistic curve, fitted to
   the training labels, over the best and the total -ln E and score and the length gives the document's score.

Bounds: at most ``most_labelled`` labelled rows (taken in the order of a hash) train the model, at any size. Its features are all those that
their texts make significant, 16 bytes each. Of a labelled row a few numbers come to the driver, however long its text is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches
from .textkit import LOWER, Rolling, U, mix, slices

PREFIXES = (5, 6, 7, 8)
DRIFT = 1.0
MOST_SCORE = 8.0
Z_LEAST = 3.2
E_MOST = 1.0
STEP = 0.01
PRIOR = 500.0
LEAST_PRIOR = 0.5
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


class Tokens:
    """Runs of letters of some texts: hashes of the run and of its prefix, place in the text, and number of each text's runs."""

    def __init__(self, texts: list[bytes]):
        data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = LETTER[data]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        base = np.cumsum(lengths) - lengths
        self.first = np.append(np.searchsorted(starts, base), len(starts))
        owner = np.searchsorted(base, starts, "right") - 1
        self.starts, self.ends = starts - base[owner], ends - base[owner]
        roll = Rolling(data)
        self.word = mix(roll.of(starts, ends), 1)
        self.prefixes = [mix(roll.of(starts, np.minimum(starts + k, ends)), 2) for k in PREFIXES]


@dataclass
class Model:
    keys: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 0.0)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.scores[at], 0.0)

    def token_scores(self, t: Tokens) -> np.ndarray:
        score = self.of(t.word)
        for prefix in t.prefixes:
            score = np.maximum(score, self.of(prefix))
        return score

    def segments(self, texts: list[bytes]) -> Iterator[tuple[int, int, list[tuple[float, int, int]]]]:
        """For each text: tokens, tokens with a score, and its maximal segments (score, begin, end in bytes)."""
        for a, b in slices(texts):
            t = Tokens(texts[a:b])
            score = self.token_scores(t)
            hits = np.flatnonzero(score > 0)
            cut = np.searchsorted(hits, t.first).tolist()
            for i in range(b - a):
                own = hits[cut[i] : cut[i + 1]]
                yield int(t.first[i + 1] - t.first[i]), len(own), maximal_segments(own.tolist(), score[own].tolist(), t.starts[own].tolist(), t.ends[own].tolist()) if len(own) else []

    def significant(self, n: int, segments: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
        """The segments of which fewer than E_MOST are expected by chance in n tokens, with -ln E."""
        floor = math.log(self.k * max(n, 1))
        rated = [(self.rate * s - floor, a, b) for s, a, b in segments]
        return [x for x in rated if x[0] >= -math.log(E_MOST)]

    def evidence(self, n: int, segments: list[tuple[float, int, int]]) -> list[float]:
        """What the curve is over: 1, best and total -ln E of the significant segments, best and total score, length."""
        found = [x[0] for x in self.significant(n, segments)]
        scores = [s for s, _, _ in segments]
        return [1.0, *(math.log1p(x) for x in (max(found, default=0.0), sum(found), max(scores, default=0.0), sum(scores), n))]

    def probability(self, evidence: list[list[float]]) -> np.ndarray:
        rows = np.array(evidence, float).reshape(-1, len(self.curve))
        return 1 / (1 + np.exp(-np.clip(rows @ np.array(self.curve), -30, 30)))


def maximal_segments(at: list[int], scores: list[float], starts: list[int], ends: list[int]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments, in linear time. ``at``: places of the tokens that score; those between cost DRIFT."""
    out: list[tuple[float, float, int, int, int]] = []  # sum before, sum behind, begin, end, last one with a smaller sum before
    total, place = 0.0, at[0]
    for p, s, begin, end in zip(at, scores, starts, ends):
        total -= DRIFT * max(p - place - 1, 0)
        place, before, total = p, total, total + s
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= before:
                j = out[j][4]
            if j < 0 or out[j][1] >= total:
                out.append((before, total, begin, end, j))
                break
            before, begin = out[j][0], out[j][2]
            up = out[j][4]
            del out[j:]
            j = up
    return [(behind - before, begin, end) for before, behind, begin, end, _ in out]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch, how many toxic and other documents have each feature."""
    for batch in batches:
        texts, toxic = batch.column("t").cast(pa.binary()).to_pylist(), batch.column("toxic").to_numpy(zero_copy_only=False)
        keys, sides = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            t = Tokens(texts[a:b])
            for i in range(b - a):
                own = slice(int(t.first[i]), int(t.first[i + 1]))
                found = np.unique(np.concatenate([x[own] for x in (t.word, *t.prefixes)]))
                keys.append(found)
                sides.append(np.full(len(found), toxic[a + i], np.int64))
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        side = np.concatenate(sides)
        yes, all_ = np.bincount(where, side, len(keys)).astype(np.int64), np.bincount(where, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(yes), pa.array(all_ - yes)], ["key", "yes", "no"])


def _best(model: Model):
    """Of each labelled text its tokens and its best segment's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, max((s for s, _, _ in got), default=0.0)) for n, _, got in model.segments(batch.column("t").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["toxic", "n", "best"])

    return run


def _evidence(model: Model):
    """Of each labelled text what the curve is over: six numbers, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.evidence(n, got) for n, _, got in model.segments(batch.column("t").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "evidence"])

    return run


def _token_scores(model: Model):
    """Of each batch, how many tokens have each positive score, in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column("t").cast(pa.binary()).to_pylist(), np.zeros(round(MOST_SCORE / STEP) + 1, np.int64)
            for a, b in slices(texts):
                score = model.token_scores(Tokens(texts[a:b]))
                counts += np.bincount(np.rint(score[score > 0] / STEP).astype(np.int64), minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["step", "n"])

    return run


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(rate * s)] = 1; the shares leave the rest to -DRIFT."""
    if not len(scores):
        return 1.0
    rest, low, high = 1 - share.sum(), 1e-6, 20.0
    if rest * -DRIFT + (share * scores).sum() >= 0:
        return 0.05  # no negative drift: hardly any significance
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * scores, 300))).sum() + rest * math.exp(-mid * DRIFT) < 1 else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Ridge logistic regression; the first column of x is 1. Newton steps, each halved until the penalised loss, which is convex, falls:
    this ends at its minimum where the classes can be parted too."""
    ridge = np.diag([1e-3, *[0.1] * (x.shape[1] - 1)])
    loss = lambda w: float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + w @ ridge @ w / 2)
    w = np.zeros(x.shape[1])
    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (y - p) - ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, slope)
        size = 1.0
        while loss(w + size * step) > at - 1e-4 * size * (slope @ step) and size > 1e-9:
            size /= 2
        w = w + size * step
        before, at = at, loss(w)
        if before - at <= 1e-12 * max(abs(at), 1e-9):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 40_000) -> Model:
    """Learn from the labelled training documents: those whose crc32(id as text) modulo 3 is not 1.

    Rows with a null id or label teach nothing; an id labelled more than once is toxic if one row says so. Without
    labels of both kinds the model has no features and scores every text the share of toxic labels, 0.5 without any.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "toxic")
    train = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("int").alias("toxic")).where("l is not null and toxic is not null")
    train = train.where(F.crc32(F.col("l").cast("string")) % 3 != 1).groupBy("l").agg(F.max("toxic").alias("toxic"))
    train = train.orderBy(F.xxhash64("l"), "l").limit(most_labelled)  # bounded: at most so many rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(train), F.col("d") == F.col("l"))
    texts = scratch.table(texts.select("toxic", "t"), "train")
    counts = scratch.table(texts.mapInArrow(_count, "key long, yes long, no long").groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "counts")
    sums = counts.agg(F.coalesce(F.sum("yes"), F.lit(0)).alias("y"), F.coalesce(F.sum("no"), F.lit(0)).alias("n")).first()
    y, n = float(sums["y"]), float(sums["n"])
    model = Model(np.zeros(0, U), np.zeros(0))
    if y and n:
        prior = F.lit(LEAST_PRIOR) + (F.col("yes") + F.col("no")) / F.lit(y + n) * F.lit(PRIOR)
        logit = lambda c, all_: F.log((c + prior) / (F.lit(all_ + PRIOR) - c - prior))
        delta = logit(F.col("yes"), y) - logit(F.col("no"), n)
        spread = F.sqrt(1 / (F.col("yes") + prior) + 1 / (F.col("no") + prior))
        rated = counts.where("yes >= 2").select("key", (delta - spread).alias("delta"), (delta / spread).alias("z")).where(F.col("z") >= Z_LEAST)
        # One standard error less than the log-odds: few sightings make a weak score.
        top = rated.select("key", "delta").toPandas()  # features of two or more toxic documents among the labelled ones
        keys = top["key"].to_numpy(np.int64).view(U)
        by = np.argsort(keys)
        model = Model(keys[by], np.minimum(top["delta"].to_numpy(float), MOST_SCORE)[by])
    rows = texts.mapInArrow(_best(model), "toxic int, n long, best double").toPandas()  # three numbers for each labelled row
    hits = scratch.table(texts.where("toxic = 0").mapInArrow(_token_scores(model), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")), "hits")
    scratch.drop("counts")
    toxic = rows["toxic"].to_numpy(float)
    clean = rows[rows["toxic"] == 0]
    n_clean = max(float(clean["n"].sum()), 1.0)
    steps = hits.toPandas()  # a row for each step at most
    model.rate = _rate(steps["step"].to_numpy(float) * STEP, steps["n"].to_numpy(float) / n_clean)
    best = clean["best"].to_numpy(float)
    chance = float((clean["n"].to_numpy(float) * np.exp(-model.rate * best)).sum())
    model.k = max(int((best > 0).sum()) / chance, 1e-4) if chance else 1e-3
    if len(rows) and 0 < toxic.sum() < len(rows):
        found = texts.mapInArrow(_evidence(model), "toxic int, evidence array<double>").toPandas()  # six numbers for each labelled row
        model.curve = tuple(_logistic(np.stack(found["evidence"].to_numpy()), found["toxic"].to_numpy(float)))
    else:
        share = (toxic.sum() + 1) / (len(rows) + 2)
        model.curve = (math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0)
    scratch.drop("train")
    return model


def _scores(model: Model, texts: list[bytes]) -> np.ndarray:
    return model.probability([model.evidence(n, segments) for n, _, segments in model.segments(texts)])


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the significant passages (byte begin and end, -ln E) of each whole text; null text is empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("strength", pa.float64())]))
        for batch in batches:
            got = [(n, s) for n, _, s in model.segments(batch.column("t").cast(pa.binary()).to_pylist())]
            score = model.probability([model.evidence(n, s) for n, s in got])
            found = [[{"begin": a, "end": b, "strength": e} for e, a, b in model.significant(n, s)] for n, s in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "passages"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    return own.mapInArrow(run, "doc_id long, score double, passages array<struct<begin:long,end:long,strength:double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns; no shuffle."""
    bounded_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(where).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(_scores(model, texts) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false for a null id), score, predicted for each row of ``docs``; an empty table gives no rows."""
    scored = passages(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
