"""Context usage and the tick machine over an append-only log, as batch windows and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"

USAGE = "type string, message struct<role:string, usage:struct<input_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long,output_tokens:long>>"


def used_tokens(usage: Column) -> Column:
    """Input, cache creation and cache reads; what is missing is 0, output does not count."""
    zero = F.lit(0).cast("long")
    return F.coalesce(usage["input_tokens"], zero) + F.coalesce(usage["cache_creation_input_tokens"], zero) + F.coalesce(usage["cache_read_input_tokens"], zero)


def used_pct(used: Column, window: int) -> Column:
    return F.floor(used * 100 / F.lit(window)).cast("long") if window else F.lit(0).cast("long")


def read_usage(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines with used_tokens: null for lines that are bad, of another type or without usage."""
    usage = F.from_json(value, USAGE)
    has = (usage["type"] == "assistant") & usage["message"]["usage"].isNotNull()
    return lines.withColumn("used_tokens", F.when(has, used_tokens(usage["message"]["usage"])))


def last_usage(log: DataFrame, key: str, order: str, threshold: int = 85, window: int = 200_000) -> DataFrame:
    """The last usage of each key: used_tokens, used_pct, window_size, should_extract; no row for keys without one."""
    last = log.where("used_tokens is not null").groupBy(key).agg(F.max_by("used_tokens", order).alias("used_tokens"))
    return last.withColumn("used_pct", used_pct(F.col("used_tokens"), window)).withColumn("window_size", F.lit(window).cast("long")).withColumn("should_extract", F.col("used_pct") >= threshold)


def tick_actions(ticks: DataFrame, key: str, order: list, every: int = 20) -> DataFrame:
    """ticks (key, order, extract) with action and counter: Extract resets, else each ``every``-th tick since the last reset is a
    Snapshot. The closed form of the state machine below."""
    by = Window.partitionBy(key).orderBy(*order)
    grouped = ticks.withColumn("g", F.sum(F.col("extract").cast("int")).over(by))
    inner = Window.partitionBy(key, "g", "extract").orderBy(*order)
    r = F.row_number().over(inner)
    numbered = grouped.withColumn("r", r)
    action = F.when(F.col("extract"), "Extract").when(F.col("r") % every == 0, "Snapshot").otherwise("None")
    return numbered.withColumn("action", action).withColumn("counter", F.when(F.col("extract"), 0).otherwise(F.col("r") % every).cast("long")).drop("g", "r")


TICKS = T.StructType([T.StructField("key", T.StringType()), T.StructField("order", T.LongType()), T.StructField("action", T.StringType()), T.StructField("counter", T.LongType())])


class TickProcessor(StatefulProcessor):
    """One counter of state for each key, which expires when a key has had no tick for ``idle_ms`` (never if that is None)."""

    def __init__(self, every: int, idle_ms: int | None):
        self.every, self.idle_ms = every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "n long", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        counter = self.counter.get()[0] if self.counter.exists() else 0
        for row in sorted(rows, key=lambda r: r["order"]):
            counter += 1
            action = "Extract" if row["extract"] else "Snapshot" if counter >= self.every else "None"
            counter = counter if action == "None" else 0
            yield Row(key=key[0], order=row["order"], action=action, counter=counter)
        self.counter.update((counter,))

    def close(self) -> None:
        pass


def tick_stream(ticks: DataFrame, every: int = 20, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream of (key string, order long, extract boolean), for outputMode append. Rows of a key in a micro-batch are
    taken in order; a stream that starts again from its checkpoint goes on from its counters. State is kept by RocksDB, which this sets for
    a session that has set no state store of its own."""
    spark = ticks.sparkSession
    if spark.conf.get(_STORE, _DEFAULT_STORE) == _DEFAULT_STORE:
        spark.conf.set(_STORE, _DEFAULT_STORE.replace("HDFSBackedStateStoreProvider", "RocksDBStateStoreProvider"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    return ticks.groupBy("key").transformWithState(TickProcessor(every, idle_ms), TICKS, "append", mode)


def usage_stream(lines: DataFrame, key: str = "file", threshold: int = 85, window: int = 200_000) -> DataFrame:
    """Running last usage of each key over a stream with an increasing line_no; for outputMode update."""
    log = read_usage(lines).where("used_tokens is not null").groupBy(key).agg(F.max_by("used_tokens", "line_no").alias("used_tokens"))
    pct = used_pct(F.col("used_tokens"), window)
    return log.withColumn("used_pct", pct).withColumn("should_extract", pct >= threshold)
