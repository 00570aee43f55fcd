"""Chat formatting with Spark expressions only.

Template: a block for each run of turns of one role, ``### ROLE: TEXT(<+>TEXT)*</turn>\\n``. Inside roles and
texts a backslash is put before each backslash, ``#`` and ``:``, and into each ``</turn>`` and ``<+>`` after the
``<``, so that neither a header, a separator nor an end can occur in them; removing the backslash before any
character undoes it. Turns merge in the output, and can be told apart again when it is read back.

A conversation is one output string, so its turns meet in one row: sorting, merging and joining them are linear
in their number, and a conversation must fit into one row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", "<+>", "</turn>\n"
CONTROL = r"### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    out = text
    for plain, safe in (("\\", "\\\\"), ("#", "\\#"), (":", "\\:"), ("</turn>", "<\\/turn>"), ("<+>", "<\\+>")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (start from 1 and length in code points).

    The mask covers the escaped texts of the role ``learn``, without headers, separators or ends. Null role or
    text: empty. Turns go by turn (null first), then role, then text; rows that are the same stay as often
    as they come. A null conv_id is a conversation of its own. An empty table gives no rows. Other columns of
    ``turns`` are not read.
    """
    item = F.struct(turns[turn].alias("n"), F.coalesce(turns[role], F.lit("")).alias("r"), F.coalesce(turns[text], F.lit("")).alias("t"))
    got = turns.select(turns[conv_id].alias("conv_id"), item.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("a"))
    last = F.size("a") - 1

    def at(i: Column) -> Column:
        return F.get(F.col("a"), i)["r"]

    def piece(x: Column, i: Column) -> Column:
        fresh = (i == 0) | (at(i - 1) != x["r"])
        closes = (i == last) | (at(i + 1) != x["r"])
        before = F.when(fresh, F.concat(F.lit(HEAD), escape(x["r"]), F.lit(": "))).otherwise(F.lit(SEP))
        return F.struct(before.alias("b"), escape(x["t"]).alias("t"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("e"), (x["r"] == learn).alias("m"))

    got = got.select("conv_id", F.transform("a", piece).alias("p"))
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["b"], x["t"], x["e"])), "")
    lengths = F.transform("p", lambda x: F.struct((F.length(x["b"])).alias("b"), F.length(x["t"]).alias("t"), F.length(x["e"]).alias("e"), x["m"].alias("m")))
    got = got.select("conv_id", formatted.alias("formatted"), lengths.alias("l"))
    # Starts are running sums, made in about sqrt(n) chunks: arrays are copied to append, so one pass over all
    # turns would copy the square of their number.
    got = got.withColumn("k", F.greatest(F.ceil(F.sqrt(F.size("l"))), F.lit(1)).cast("int"))
    got = got.withColumn("c", F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / F.col("k")).cast("int")), lambda i: F.slice("l", i * F.col("k") + 1, F.col("k"))))
    totals = F.transform("c", lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["b"] + x["t"] + x["e"]))
    got = got.withColumn("at", F.aggregate(totals, F.array(F.lit(1)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n))))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["b"]
        span = F.when(x["m"] & (x["t"] > 0), F.array(F.struct(begin.alias("start"), x["t"].alias("length")))).otherwise(none)
        return F.struct((begin + x["t"] + x["e"]).alias("at"), F.concat(s["spans"], span).alias("spans"))

    spans = F.transform("c", lambda c, i: F.aggregate(c, F.struct(F.get(F.col("at"), i).alias("at"), none.alias("spans")), step)["spans"])
    return got.select("conv_id", "formatted", F.flatten(spans).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text and formatted, from the output of ``format_chats`` alone."""

    def block(b: Column) -> Column:
        head = F.regexp_extract(b, r"(?s)\A### (?:[^\\:]++|\\.)*+: ", 0)
        role = unescape(F.substr(head, F.lit(len(HEAD) + 1), F.greatest(F.length(head) - len(HEAD) - 2, F.lit(0))))
        texts = F.split(F.substr(b, F.length(head) + 1), r"<\+>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split("formatted", "</turn>\n", -1), lambda b: b != "")
    masked = F.array_join(F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"], s["length"])), "")
    return chats.select("conv_id", F.flatten(F.transform(blocks, block)).alias("turns"), unescape(masked).alias("loss_text"), "formatted")


def op2_format(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    own = conversations.select("conv_id", "turn", "role", "text")
    first = F.col("id") == 0
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(first, "user").otherwise("assistant").alias("role"), F.lit("\\" + CONTROL).alias("text"))
    back = read_back(format_chats(own.unionByName(extra)))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM c),
k AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY n) IS DISTINCT FROM r OR n = 1 AS fresh FROM o),
z AS (SELECT *, length(replace(replace(replace(replace(replace(t, '\', '\\'), '#', '\#'), ':', '\:'), '</turn>', '<\/turn>'), '<+>', '<\+>')) AS te,
    length(replace(replace(replace(replace(replace(r, '\', '\\'), '#', '\#'), ':', '\:'), '</turn>', '<\/turn>'), '<+>', '<\+>')) AS re FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY n) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
    CAST(sum(te + CASE WHEN fresh THEN re + 14 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM z GROUP BY conv_id
"""
