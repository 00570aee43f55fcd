"""Conversations as text: (session_id, ord, role, content, ts) rows. Sums and cuts are in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import byte_prefix, truncated

# What marks automated sessions, and messages that are commands or prompts of a tool.
AUTOMATED = ["Analyze the following", "Extract entities", "You are a knowledge graph", "Extract the key facts"]
COMMAND_STARTS = ["<command-", "<local-command", "/", "Caveat:"]
PROMPT_PARTS = ["Extract entities", "knowledge graph", "Return ONLY valid JSON"]


def message_text(content: Column) -> Column:
    """Text of a message that is a JSON string or an array of blocks: text blocks, and tools as [Tool: name (k=v, ...)] with three
    inputs at most (command, prompt and long values shortened or left out); other blocks are left out. Null: empty."""
    plain = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"]
    blocks = F.from_json(content, "array<struct<type:string,text:string,name:string,input:map<string,string>>>")
    short = lambda v: F.when(F.octet_length(v) > 50, F.concat(byte_prefix(v, 47), F.lit("..."))).otherwise(v)
    shown = lambda m: F.array_join(F.slice(F.transform(F.filter(F.map_entries(m), lambda e: ~e["key"].isin("command", "prompt")), lambda e: F.concat(e["key"], F.lit("="), short(e["value"]))), 1, 3), ", ")
    tool = lambda b: F.concat(F.lit("[Tool: "), b["name"], F.when(F.coalesce(shown(b["input"]), F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" ("), shown(b["input"]), F.lit(")"))), F.lit("]"))
    lines = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "tool_use")), lambda b: F.when(b["type"] == "text", b["text"]).otherwise(tool(b)))
    listed = F.array_join(lines, "\n")
    return F.coalesce(F.when(F.ltrim(content).startswith("["), listed).otherwise(plain), F.lit(""))


def parse_lines(lines: DataFrame, value: str = "value", session: str = "file") -> DataFrame:
    """Messages of transcript lines (session column, line_no, value): bad lines, other roles and empty contents are dropped; a
    session's id is the first that a line names. A content is an array of blocks if the line's JSON has an array there; a text that
    begins with a bracket is a text."""
    shape = "type string, sessionId string, timestamp string, message struct<role:string,content:string>"
    read = lines.withColumn("j", F.from_json(value, shape)).where("j.type in ('user', 'assistant') and j.message.role in ('user', 'assistant')")
    blocks = F.try_variant_get(F.try_parse_json(value), "$.message.content", "array<variant>").isNotNull()
    content = F.when(blocks, message_text(F.col("j.message.content"))).otherwise(F.col("j.message.content"))
    read = read.select(session, "line_no", F.col("j.message.role").alias("role"), content.alias("content"), F.col("j.timestamp").alias("ts"), F.col("j.sessionId").alias("sid")).where("content <> ''")
    ids = read.where("sid is not null").groupBy(F.col(session).alias("s")).agg(F.min_by("sid", "line_no").alias("session_id"))
    return read.join(ids, F.col(session) == F.col("s"), "left").select(F.coalesce("session_id", F.col(session)).alias("session_id"), F.col("line_no").alias("ord"), "role", "content", "ts")


def dedup_turns(messages: DataFrame) -> DataFrame:
    """Consecutive assistant messages of one timestamp become one: the longest text, in the first one's place."""
    order = Window.partitionBy("session_id").orderBy("ord")
    same = (F.col("role") == "assistant") & (F.lag("role").over(order) == "assistant") & (F.col("ts") == F.lag("ts").over(order))
    group = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order)
    longest = F.max_by("content", F.struct(F.octet_length("content").alias("n"), (-F.col("ord")).alias("o")))
    return messages.withColumn("g", group).groupBy("session_id", "g").agg(F.min("ord").alias("ord"), F.min_by("role", "ord").alias("role"), longest.alias("content"), F.min_by("ts", "ord").alias("ts")).drop("g")


def automated(messages: DataFrame) -> DataFrame:
    """(session_id, automated): two messages at most, the first of which starts with or contains a tool's prompt."""
    first = F.min_by("content", "ord")
    hit = F.lit(False)
    for p in AUTOMATED:
        hit = hit | first.contains(p)
    return messages.groupBy("session_id").agg(((F.count(F.lit(1)) <= 2) & hit).alias("automated"))


def label(role: Column) -> Column:
    return F.when(role == "user", "User").otherwise("Assistant")


def flow_text(messages: DataFrame, most: int = 50_000) -> DataFrame:
    """(session_id, text): [User]: ... paragraphs in order, cut to ``most`` bytes. Only rows that begin inside the limit are gathered."""
    piece = F.concat(F.lit("["), label(F.col("role")), F.lit("]: "), F.col("content"), F.lit("\n\n"))
    return _joined(messages.withColumn("piece", piece), most)


def _joined(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("ord")
    begun = rows.withColumn("before", F.sum(F.octet_length("piece")).over(order) - F.octet_length("piece")).where(F.col("before") < most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "")
    return begun.groupBy("session_id").agg(text.alias("text")).select("session_id", byte_prefix(F.col("text"), most).alias("text"))


def user_text(messages: DataFrame, most: int = 50_000) -> DataFrame:
    """(session_id, text): user messages of fifteen bytes or more that are neither commands nor tool prompts."""
    own = F.col("content")
    skip = F.lit(False)
    for p in COMMAND_STARTS:
        skip = skip | own.startswith(p)
    for p in PROMPT_PARTS:
        skip = skip | own.contains(p)
    return _joined(messages.where((F.col("role") == "user") & (F.octet_length("content") >= 15) & ~skip).withColumn("piece", F.concat(own, F.lit("\n\n"))), most)


def substantive_text(messages: DataFrame, most: int = 50_000) -> DataFrame:
    """(session_id, text): messages of fifteen bytes or more, other roles than user cut to 300 bytes; all of them if they fit, else
    the first fifth, the third and the last with 20, 40 and 40 percent of the bytes, divided by [...]."""
    text = F.when(F.col("role") == "user", F.col("content")).otherwise(truncated(F.col("content"), 300))
    rows = messages.where(F.octet_length("content") >= 15).withColumn("body", text).withColumn("who", label(F.col("role")))
    whole, order = Window.partitionBy("session_id"), Window.partitionBy("session_id").orderBy("ord")
    rows = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("size", F.sum(F.octet_length("who") + F.octet_length("body") + 10).over(whole))
    rows = rows.withColumn("piece", F.concat(F.lit("["), F.col("who"), F.lit("]: "), F.col("body"), F.lit("\n\n"))).withColumn("fits", F.col("size") <= most)
    n, k = F.col("n"), F.col("k")
    fifth = lambda x: F.floor(n * x / 5)
    section = F.when(F.col("fits"), 0).when(k < fifth(1), 0).when((k >= fifth(2)) & (k < fifth(3)), 1).when(k >= fifth(4), 2)
    rows = rows.withColumn("section", section).where("section is not null")
    inner = Window.partitionBy("session_id", "section").orderBy("ord")
    budget = F.when(F.col("fits"), F.lit(most)).when(F.col("section") == 0, int(most * 0.2)).otherwise(int(most * 0.4))
    # A section that begins behind the first message has a mark, of three messages also the empty third fifth.
    marks = F.when((F.col("section") == 2) & (n == 3), 2).when(fifth(2 * F.col("section")) > 0, 1).otherwise(0)
    mark = F.when(~F.col("fits") & (F.col("section") > 0) & (F.row_number().over(inner) == 1), F.repeat(F.lit("\n[...]\n\n"), marks)).otherwise("")
    rows = rows.withColumn("piece", F.concat(mark, F.col("piece"))).withColumn("before", F.sum(F.octet_length("piece")).over(inner) - F.octet_length("piece")).where(F.col("before") < budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("session_id").agg(joined.alias("text")).select("session_id", byte_prefix(F.col("text"), most).alias("text"))
