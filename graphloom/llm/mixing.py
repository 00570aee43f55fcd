"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document gets the exponential key ``-ln(u) / w``: u is a hash of its id and text, w a weight for its
quality, so a walk in ascending key order is a weighted sample without replacement. A source is walked
completely as often as its target allows (complete epochs); the rest of the target goes to the documents
with the smallest keys, up to the running sum of sizes that comes nearest to it (fractional selection).

No source is gathered in a task. Sizes are summed by (source, key bucket), a source of n rows has 4 sqrt(n) buckets, and
only the one bucket in which the budget ends is put in order. Buckets are even steps of exp(-LEAST_WEIGHT * key): of documents
of weight w, a bucket holds a share of at most w / (LEAST_WEIGHT * buckets), so about sqrt(n) rows, whatever the weights. What that yields for each
source is a cut (bucket, key, id, hash), and each document compares itself with the cut of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Weights are from here to 1.
LEAST_WEIGHT = 0.25
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for a text without mark-up symbols down to 0.25 where they are a tenth of it or more."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    share = marks.cast("double") * 10.0 / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.lit(1.0) - F.lit(1.0 - LEAST_WEIGHT) * F.coalesce(F.least(share, F.lit(1.0)), F.lit(0.0))


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str, weight, seed: str) -> list[Column]:
    t, i = docs[text], docs[doc_id].cast("string")
    digest = F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(i, F.lit("null")), F.lit("|"), F.coalesce(t, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return [docs[source].alias("m_source"), word_count(t).alias("m_size"), (-F.log(u) / (weight or quality_weight)(t)).alias("m_key"), digest.alias("m_tie")]


def _bucket(rows: Column) -> Column:
    return F.floor((F.lit(1.0) - F.exp(F.col("m_key") * -LEAST_WEIGHT)) * rows).cast("long")


def targets(sizes: DataFrame, share: float, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """Target of each source: ``share`` of all sizes dealt out by weight, none above ``cap`` times its own size.

    ``sizes``: one row for each source (m_source, source_size, n_rows). Dealing the excess out again until no
    source is above its cap ends where every source has the lesser of its cap and level * weight. With the
    sources by cap / weight, the level is what is left after the first caps over the weights after them.
    """
    by_name = Window.orderBy(F.col("m_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("full", F.col("source_size").cast("double") * cap).withColumn("ratio", F.col("full") / F.col("w"))
    order = Window.orderBy("ratio", F.col("m_source").asc_nulls_last())
    whole = Window.orderBy("ratio", F.col("m_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum(F.col("source_size").cast("double")).over(whole) * share - before) / after
    dealt = ranked.withColumn("pos", F.row_number().over(order)).withColumn("lam", level).withColumn("free", F.col("lam") <= F.col("ratio"))
    first = F.min(F.when(F.col("free"), F.struct("pos", "lam"))).over(whole)["lam"]
    return dealt.withColumn("target", F.when(F.col("free"), F.least(F.col("full"), first * F.col("w"))).otherwise(F.col("full"))).select("m_source", "source_size", "n_rows", "target")


def _cuts(slim: DataFrame, scratch: Scratch, share: float, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """One row for each source: target, complete epochs, number of buckets, and the cut of the fraction."""
    sizes = slim.groupBy("m_source").agg(F.sum("m_size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goal = targets(sizes, share, cycle, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    goal = goal.withColumn("n_buckets", F.ceil(F.sqrt("n_rows") / LEAST_WEIGHT).cast("double")).withColumnRenamed("m_source", "g_source")
    goal = scratch.table(goal, "goal")
    same = F.col("m_source").eqNullSafe(F.col("g_source"))
    dealt = slim.join(goal.select("g_source", "n_buckets"), same).withColumn("bucket", _bucket(F.col("n_buckets")))
    filled = dealt.groupBy("g_source", "bucket").agg(F.sum("m_size").alias("filled"))
    upto = Window.partitionBy("b_source").orderBy("bucket")
    ends = filled.withColumnRenamed("g_source", "b_source").withColumn("after", F.sum("filled").over(upto))
    ends = ends.join(goal.select("g_source", "rest"), F.col("b_source").eqNullSafe(F.col("g_source"))).where("after > rest").groupBy("b_source", "rest").agg(F.min(F.struct("bucket", "after", "filled")).alias("x"))
    ends = scratch.table(ends.select("b_source", "rest", F.col("x.bucket").alias("cut_bucket"), (F.col("x.after") - F.col("x.filled")).alias("offset")), "ends")
    last = dealt.join(ends, F.col("m_source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("cut_bucket")))
    run = Window.partitionBy("b_source").orderBy("m_key", "m_tie")
    last = last.withColumn("mid", F.col("offset") + F.sum("m_size").over(run) - F.col("m_size") / 2.0).where("mid <= rest and rest > 0")
    last = last.groupBy("b_source").agg(F.max(F.struct("m_key", "m_tie")).alias("cut"))
    last = last.select(F.col("b_source").alias("l_source"), F.col("cut.m_key").alias("cut_key"), F.col("cut.m_tie").alias("cut_tie"))
    out = goal.join(ends.drop("rest", "offset"), F.col("g_source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
    out = out.join(last, F.col("g_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    return scratch.table(out.select("g_source", "source_size", "target", "epochs", "n_buckets", "cut_bucket", "cut_key", "cut_tie"), "cuts")


def _copies() -> Column:
    bucket, cut = _bucket(F.col("n_buckets")), F.col("cut_bucket")
    within = F.struct("m_key", "m_tie") <= F.struct(F.col("cut_key").alias("m_key"), F.col("cut_tie").alias("m_tie"))
    chosen = F.coalesce((bucket < cut) | ((bucket == cut) & F.coalesce(within, F.lit(False))), F.lit(False))
    return F.col("epochs") + chosen.cast("long")


def mix_plan(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", share: float = 1.5, cycle: tuple[int, ...] = (3, 1, 2), cap: float = 2.0, weight=None, seed: str = "mix") -> DataFrame:
    """How often the mix takes each row of ``docs``: its columns, then size, source_size, target, copies.

    Null text has size 0, a null source is a source of its own, after all others. A null id is hashed as such.
    Rows equal in id and text have one key and are taken together. Sources of size 0 have target 0. An
    empty table gives no rows. Reruns agree: nothing is random. Columns of ``docs`` keep their names and are
    referred to before any other is added, so further columns may have any name but those four.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = lambda d: _keyed(d, text, source, doc_id, weight, seed)
    slim = scratch.table(docs.select(*keyed(docs)), "slim")
    cuts = _cuts(slim, scratch, share, cycle, cap)
    scratch.drop("slim", "goal", "ends")
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("m_row"), *keyed(docs))
    wide = wide.join(cuts, F.col("m_source").eqNullSafe(F.col("g_source"))).withColumn("m_copies", _copies())
    return wide.select("m_row.*", F.col("m_size").alias("size"), "source_size", "target", F.col("m_copies").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it, with the columns of ``docs``."""
    plan = mix_plan(docs, **options).where("copies > 0")
    return plan.withColumn("m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mix(docs: DataFrame) -> DataFrame:
    plan = mix_plan(docs.select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')) AS tie FROM documents),
k AS (SELECT doc_id, source, size, tie, -ln((CAST(CAST('0x' || substr(tie, 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
    / (CAST(1 AS DOUBLE) - CAST(0.75 AS DOUBLE) * least(CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS DOUBLE) * CAST(10 AS DOUBLE) / CAST(greatest(length(t), 1) AS DOUBLE), CAST(1 AS DOUBLE))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT source, source_size, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * CAST(2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS pos,
    (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * CAST(1.5 AS DOUBLE) - (sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
    / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w),
g AS (SELECT source, source_size, CASE WHEN lam <= ratio THEN least(cap, (SELECT min_by(lam, pos) FROM l WHERE lam <= ratio) * w) ELSE cap END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, greatest(e.target - e.epochs * e.source_size, 0) AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.tie) - k.size / CAST(2 AS DOUBLE) AS mid FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND mid <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
