"""Scores, and prefixes of a ranking that fit a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FACT_TYPES, TIER_WEIGHT

DAY = 86400.0


def tier_weight(tier: Column) -> Column:
    out = F.lit(TIER_WEIGHT["Minor"])
    for name, weight in TIER_WEIGHT.items():
        out = F.when(tier == name, weight).otherwise(out)
    return out


def parse_tier(text: Column) -> Column:
    """Tier by its name, case ignored; anything else is Minor."""
    return F.when(F.lower(text) == "critical", "Critical").when(F.lower(text) == "significant", "Significant").otherwise("Minor")


def relevance(tier: Column, created_at: Column, now: Column | int, superseded_by: Column, is_code: Column) -> Column:
    """0 if superseded; the tier's weight for code and Critical; else the weight times e^(-rate * days), age 0 at least."""
    now = F.lit(now) if isinstance(now, int) else now
    days = F.greatest(now - created_at, F.lit(0)).cast("double") / DAY
    decay = F.when(tier == "Critical", 1.0).when(tier == "Significant", F.lit(0.6) * F.exp(F.lit(-0.01) * days)).otherwise(F.lit(0.3) * F.exp(F.lit(-0.05) * days))
    return F.when(superseded_by.isNotNull(), 0.0).when(is_code, tier_weight(tier)).otherwise(decay)


def is_code(source: str = "source") -> Column:
    return F.col(f"{source}.kind") == "CodeAnalysis"


def within_budget(rows: DataFrame, order: list, size: Column, budget: int, spent: Column | int = 0, part: list | None = None) -> DataFrame:
    """Rows in order up to the first that does not fit. The sum is over one task's rows unless ``part`` divides them, so
    callers rank and limit first where many rows could fit: a row costs a byte at least, so ``budget`` rows are enough."""
    window = (Window.partitionBy(*part) if part else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.lit(spent) if isinstance(spent, int) else spent
    return rows.withColumn("used", spent + F.sum(size).over(window)).where(F.col("used") <= budget)


def keyword_scores(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with a hit, with a score: +2 for each query word (over two bytes, repeats count) in the name, +1 in the definition;
    facts +10; tests * 0.1, imports * 0.05, fields * 0.3."""
    words = [w for w in query.lower().split() if len(w.encode()) > 2]
    if not words:
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    name, text = F.lower("name"), F.lower(F.coalesce("definition", F.lit("")))
    hits = sum((F.when(name.contains(w), 2.0).otherwise(0.0) + F.when(text.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0))
    test = F.col("node_type").isin("Function", "Method", "Struct", "Enum") & name.startswith("test_")
    score = F.when(F.col("node_type").isin(*FACT_TYPES), F.col("hits") + 10.0).when(test, F.col("hits") * 0.1).when(F.col("node_type") == "Import", F.col("hits") * 0.05).when(F.col("node_type") == "Field", F.col("hits") * 0.3).otherwise(F.col("hits"))
    return nodes.withColumn("hits", hits).where("hits > 0").withColumn("score", score).drop("hits")


def find_relevant(nodes: DataFrame, query: str, tokens: int = 500) -> DataFrame:
    """The best hits as lines within four bytes a token, best first, up to the first that does not fit."""
    line = F.concat(F.lit("- ["), F.col("node_type"), F.lit("] "), F.col("name"), F.lit(": "), F.coalesce("definition", F.lit("")), F.lit("\n"))
    top = keyword_scores(nodes, query).withColumn("line", line).orderBy(F.desc("score"), "seq").limit(tokens * 4)
    return within_budget(top, [F.desc("score"), "seq"], F.octet_length("line"), tokens * 4).select("name", "node_type", "score", "line", "seq")


def context_report(nodes: DataFrame, now: int, tokens: int = 2000, title: str = "# Project context\n\n") -> DataFrame:
    """Lines by falling relevance (over 0.01), a header where the tier changes, within four bytes a token, title included.
    A header counts with the line it precedes."""
    budget = tokens * 4
    score = relevance(F.col("tier"), F.col("created_at"), now, F.col("superseded_by"), is_code())
    order = [F.desc("score"), "seq"]
    top = nodes.withColumn("score", score).where("score > 0.01").orderBy(*order).limit(budget)
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("definition", F.lit("")), F.lit("\n"))
    fresh = ~F.col("tier").eqNullSafe(F.lag("tier").over(Window.orderBy(*order)))
    top = top.withColumn("line", line).withColumn("header", F.when(fresh, F.concat(F.lit("## "), F.col("tier"), F.lit("\n"))).otherwise(F.lit("")))
    fit = within_budget(top, order, F.octet_length("line") + F.octet_length("header"), budget, len(title.encode()))
    return fit.select("name", "tier", "score", F.concat("header", "line").alias("line"), "seq")


def same_path(a: Column, b: Column) -> Column:
    """Paths equal, or one a suffix of the other."""
    return (a == b) | a.endswith(b) | b.endswith(a)


def file_context(nodes: DataFrame, path: str, tokens: int = 300) -> DataFrame:
    """Code nodes of a file, then remembered nodes that mention its base name, in what is left of one budget."""
    budget, base = tokens * 4, path.rsplit("/", 1)[-1]
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("definition", F.lit("")), F.lit("\n"))
    lined = nodes.withColumn("line", line)
    code = lined.where(is_code() & same_path(F.col("source.file"), F.lit(path))).orderBy("seq").limit(budget)
    code = within_budget(code, ["seq"], F.octet_length("line"), budget).withColumn("phase", F.lit(1))
    spent = code.agg(F.coalesce(F.max("used"), F.lit(0)).alias("spent"))
    told = F.col("source.kind").isin("Conversation", "Document", "Memory") & (F.coalesce(F.col("definition"), F.lit("")).contains(base) | F.col("name").contains(base))
    rest = lined.where(told).orderBy("seq").limit(budget).join(F.broadcast(spent))  # one row
    rest = within_budget(rest, ["seq"], F.octet_length("line"), budget, F.col("spent")).drop("spent").withColumn("phase", F.lit(2))
    return code.unionByName(rest).select("phase", "name", "line", "seq", "used")
