"""Precision and recall of predicted file sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    out = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, tp, fp, fn, precision, recall, f1) of the sets of (case, file); zero for an empty denominator."""
    p = predicted.select("case", "file").distinct().withColumn("p", F.lit(1))
    e = expected.select("case", "file").distinct().withColumn("e", F.lit(1))
    both = p.join(e, ["case", "file"], "full")
    counts = both.groupBy("case").agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return _metrics(counts)


def micro_average(cases: DataFrame) -> DataFrame:
    """The counts of all cases summed, then the ratios."""
    zero = F.lit(0).cast("long")
    return _metrics(cases.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("tp", "fp", "fn")]))


def report(cases: DataFrame) -> str:
    """Text with three decimals, a line for each case and a total."""
    line = lambda name, r: f"{name}: precision {r['precision']:.3f} recall {r['recall']:.3f} f1 {r['f1']:.3f} (tp {r['tp']}, fp {r['fp']}, fn {r['fn']})"
    return "\n".join([*(line(r["case"], r) for r in cases.orderBy("case").collect()), line("TOTAL", micro_average(cases).first())])
