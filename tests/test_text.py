"""Chunks, facts, transcripts, usage and ticks."""

import json
import os
import random
import time

import pyarrow as pa
import pyspark.sql.functions as F

from graphloom.functions import tables
from graphloom.functions import text as tx
from graphloom.functions import transcript as tr
from graphloom.streaming import monitor


def test_chunks():
    assert tx.chunks("") == [] and tx.chunks("short")[0][1:] == (0, 0, 5)
    long = " ".join(f"This is sentence number {k} of the text." for k in range(300))
    got = tx.chunks(long, 500, 100)
    assert len(got) > 2 and all(0 <= a < b <= len(long) for _, _, a, b in got)
    assert all(y[2] < x[3] for x, y in zip(got, got[1:])) and got[-1][3] == len(long)
    assert len(tx.chunks("a. b. c. " * 1000, 50, 49)) > 1  # ends


def plain_chunks(text, target, overlap):
    """The rule as written: split, pack disjoint runs, extend each backwards."""
    d = text.encode()
    if not d or len(d) <= target:
        return [(text, 0, 0, len(d))] if d else []
    spans, start, i = [], 0, 0
    while i < len(d):
        end = d[i : i + 1] in (b".", b"!", b"?") and d[i + 1 : i + 2] in (b" ", b"\n", b"\r") and i - start > 20
        if end or d[i : i + 2] == b"\n\n":
            if d[start : i + 1].decode().strip():
                spans.append((start, i + 1))
            start = i + 1
            while start < len(d) and d[start : start + 1] in (b" ", b"\n", b"\r"):
                start += 1
            i = start
        else:
            i += 1
    if d[start:].decode().strip():
        spans.append((start, len(d)))
    if not spans:
        return [(text, 0, 0, len(d))]
    runs, i = [], 0
    while i < len(spans):
        first, count = i, 0
        while i < len(spans) and not (count > 0 and count + spans[i][1] - spans[i][0] > target):
            count += spans[i][1] - spans[i][0]
            i += 1
        runs.append((first, i - 1))
    out = []
    for k, (first, last) in enumerate(runs):
        at, chars = first, 0
        while k and overlap > 0 and at > 0:
            chars += spans[at - 1][1] - spans[at - 1][0]
            if chars > overlap:
                break
            at -= 1
            if at <= runs[k - 1][0]:
                break
        out.append((d[spans[at][0] : spans[last][1]].decode().strip(), len(out), spans[at][0], spans[last][1]))
    return out


def test_chunks_are_the_plain_rule():
    r = random.Random(3)
    parts = ["word ", "longer words here ", ". ", "! ", "?\n", "\n\n", "é\u3000", "  ", "x" * 60]
    for k in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 200)))
        for target, overlap in ((100, 30), (60, 200), (400, 0), (4000, 500)):
            assert tx.chunks(text, target, overlap) == plain_chunks(text, target, overlap)
    assert tx.chunks(" \n") == [(" \n", 0, 0, 2)]
    assert tx.chunks("This is a sentenc 20. Then another.", 10, 0)[0][3] == 35 and tx.chunks("This is a sentence 20. Then another.", 10, 0)[0][3] == 22


def test_chunk_table_and_truncation(spark):
    docs = spark.createDataFrame([(1, "é" * 10), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["id"], r["end_offset"]) for r in tx.chunk_table(docs).collect()] == [(1, 20)]
    row = docs.where("doc_id = 1").select(tx.byte_prefix(F.col("text"), 5).alias("a"), tx.truncated(F.col("text"), 7).alias("b"), tx.truncated(F.col("text"), 20).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("éé", "ééé...", "é" * 10)


def test_facts(spark):
    said = ["we decided to use Spark for this", "the bug was caused by a null pointer", "instead of the old parser we'll use a new one", "parser depends on lexer", "the fix is to close it", "nothing to see"]
    got = tx.facts(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).groupBy("id").agg(F.collect_set("fact_type").alias("k")).collect()
    kinds = {r["id"]: set(r["k"]) for r in got}
    assert "Decision" in kinds[0] and "Error" in kinds[1] and "Supersession" in kinds[2] and "Relation" in kinds[3] and "Error" in kinds[4] and 5 not in kinds


def test_transcript(spark):
    line = lambda role, content, ts, sid="s1": json.dumps({"type": role, "sessionId": sid, "timestamp": ts, "message": {"role": role, "content": content}})
    lines = [line("user", "Please explain the whole design", "1"), "not json", "", line("assistant", "Part", "2"), line("assistant", "Part one, longer", "2"), json.dumps({"type": "summary"}),
             line("assistant", [{"type": "text", "text": "Look"}, {"type": "thinking", "thinking": "no"}, {"type": "tool_use", "name": "Read", "input": {"path": "x.py", "command": "ls"}}], "3")]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, line_no long, value string")
    rows = tr.dedup_turns(tr.parse_lines(df)).orderBy("ord").collect()
    assert [(r["session_id"], r["role"], r["content"]) for r in rows] == [("s1", "user", "Please explain the whole design"), ("s1", "assistant", "Part one, longer"), ("s1", "assistant", "Look\n[Tool: Read (path=x.py)]")]


def test_substantive_text(spark):
    rows = [("s", k, "user" if k % 2 == 0 else "assistant", f"message number {k} " + "x" * 400, None) for k in range(20)]
    df = spark.createDataFrame(rows, "session_id string, ord long, role string, content string, ts string")
    whole = tr.substantive_text(df).first()["text"]
    assert whole.count("[User]: ") == 10 and "..." in whole and "[...]" not in whole
    cut = tr.substantive_text(df, 3000).first()["text"]
    assert cut.count("[...]") == 2 and len(cut.encode()) <= 3000
    assert len(tr.flow_text(df, 100).first()["text"]) == 100


def plain_substantive(said, most):
    """The sample as written, for ASCII."""
    kept = [("User" if r == "user" else "Assistant", c if r == "user" or len(c) <= 300 else c[:300] + "...") for r, c in said if len(c) >= 15]
    line = lambda x: f"[{x[0]}]: {x[1]}\n\n"
    if sum(len(r) + len(c) + 10 for r, c in kept) <= most:
        return "".join(map(line, kept))
    n, text = len(kept), ""
    for a, b, budget in ((0, n // 5, most // 5), (n * 2 // 5, n * 3 // 5, most * 2 // 5), (n * 4 // 5, n, most * 2 // 5)):
        begun = len(text)
        text += "\n[...]\n\n" if a else ""
        for x in kept[a:b]:
            if len(text) - begun >= budget:
                break
            text += line(x)
    return text[:most]


def test_substantive_text_is_the_plain_sample(spark):
    r = random.Random(5)
    said = {f"s{n}-{j}": [(r.choice(["user", "assistant"]), f"message {k} of {n} " + "x" * r.randint(0, 500)) for k in range(n)] for n in (1, 2, 3, 4, 5, 7, 20, 61, 200) for j in range(3)}
    rows = [(s, k, role, c, None) for s, v in said.items() for k, (role, c) in enumerate(v)]
    df = spark.createDataFrame(rows, "session_id string, ord long, role string, content string, ts string")
    for most in (500, 5000, 50_000):
        assert {x["session_id"]: x["text"] for x in tr.substantive_text(df, most).collect() if x["text"]} == {s: t for s, v in said.items() if (t := plain_substantive(v, most))}


def test_usage(spark):
    use = lambda a, b, c: json.dumps({"type": "assistant", "message": {"role": "assistant", "usage": {"input_tokens": a, "cache_creation_input_tokens": b, "cache_read_input_tokens": c, "output_tokens": 99}}})
    log = spark.createDataFrame([("k", 1, use(178000, 0, 0)), ("k", 2, use(5000, 2000, 1000)), ("k", 3, "bad"), ("j", 1, use(178000, 0, 0)), ("n", 1, "{}")], "key string, line_no long, value string")
    got = {r["key"]: (r["used_tokens"], r["used_pct"], r["should_extract"]) for r in monitor.last_usage(monitor.read_usage(log), "key", "line_no").collect()}
    assert got == {"k": (8000, 4, False), "j": (178000, 89, True)}


def counter_rule(extracts, every):
    count, out = 0, []
    for x in extracts:
        count += 1
        action = "Extract" if x else "Snapshot" if count >= every else "None"
        count = count if action == "None" else 0
        out.append((action, count))
    return out


def test_ticks_batch_and_stream(spark, tmp_path):
    random.seed(7)
    rows = [(f"k{j}", k, random.random() < 0.1) for j in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "key string, order long, extract boolean")
    want = {(key, k): x for key in {r[0] for r in rows} for k, x in enumerate(counter_rule([r[2] for r in rows if r[0] == key], 7))}
    got = {(r["key"], r["order"]): (r["action"], r["counter"]) for r in monitor.tick_actions(df, "key", ["order"], 7).collect()}
    assert got == want
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    q = monitor.tick_stream(stream, 7).writeStream.format("memory").queryName("ticks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["key"], r["order"]): (r["action"], r["counter"]) for r in spark.table("ticks").collect()} == want


def test_facts_at_the_edges(spark):
    """White space of any kind is trimmed, a carriage return does not end a fact, blanks between the words of a phrase are single ones."""
    rows = [(1, "so we  use the new cache\t"), (2, "We use a cache\rand more\nnext"), (3, "instead of\u2003the old one we'll use it all"), (4, "a.b calls\tc.d\u00a0e"), (5, None), (6, ""), (7, "the approach is short"), (8, "the approach is shrt")]
    got = {(r["id"], r["fact_type"], r["fact"]) for r in tx.facts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Decision", "use the new cache"), (2, "Decision", "We use a cache\rand more"), (3, "Supersession", "instead of\u2003the old one we'll use it all"), (3, "Decision", "use it all"), (4, "Relation", "a.b calls\tc.d"), (7, "Decision", "the approach is short")}


def test_table_functions_are_the_data_frame_ones(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(["word", "longer words", "end.", "so!\n\n", "é漢"]) for _ in range(r.randint(0, 900)))) for k in range(25)] + [(90, None), (91, ""), (92, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables.register(spark)
    for target, overlap in ((4000, 500), (300, 60)):
        got = spark.sql(f"SELECT d.doc_id, c.* FROM {{df}} d, LATERAL chunks(d.text, {target}, {overlap}) c", df=df).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, tx.chunk_table(df, target=target, overlap=overlap).collect())) and len(got) > 25
    told = {(x["doc_id"], x["start_offset"], x["end_offset"]) for x in spark.sql("SELECT d.doc_id, s.* FROM {df} d, LATERAL sentences(d.text) s", df=df).collect()}
    assert told == {(k, a, b) for k, t in rows for a, b in tx.sentences((t or "").encode())}


def test_tick_stream_goes_on_after_a_restart_and_forgets_idle_keys(spark, tmp_path):
    folder = f"file://{tmp_path}/in"

    def run(name, rows, idle=None):
        spark.createDataFrame(rows, "key string, order long, extract boolean").coalesce(1).write.mode("append").parquet(f"{folder}-{name}")
        stream = spark.readStream.schema("key string, order long, extract boolean").parquet(f"{folder}-{name}")
        out = monitor.tick_stream(stream, 3, idle).writeStream.format("parquet").option("path", f"{folder}-{name}-out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp-{name}")
        read = lambda: {(r["key"], r["order"]): (r["action"], r["counter"]) for r in spark.read.schema(monitor.TICKS).parquet(f"{folder}-{name}-out").collect()}
        if idle is None:
            out.trigger(availableNow=True).start().awaitTermination(100)
            return read()
        q, end = out.trigger(processingTime="1 second").start(), time.time() + 60  # expiry keeps the clock running, so this one is stopped
        while time.time() < end and not (os.path.isdir(f"{tmp_path}/in-{name}-out") and {x[:2] for x in rows} <= set(read())):
            time.sleep(0.5)
        q.stop()
        return read()

    run("a", [("k", 1, False), ("k", 2, False), ("m", 1, True)])
    got = run("a", [("k", 3, False), ("m", 2, False)])
    assert got == {("k", 1): ("None", 1), ("k", 2): ("None", 2), ("m", 1): ("Extract", 0), ("k", 3): ("Snapshot", 0), ("m", 2): ("None", 1)}
    run("b", [("k", 1, False), ("k", 2, False)], idle=1000)
    time.sleep(1.5)
    assert run("b", [("k", 3, False)], idle=1000)["k", 3] == ("None", 1)


def test_chunks_come_back_in_bounded_batches(spark):
    class Docs:
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = tx.chunk_table(Docs())
    texts = [None, "", *[f"Sentence number {k} is here and ends. " * 3000 for k in range(60)], "short"]
    got = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"])])))
    assert len(got) > 5 and max(b.nbytes for b in got) < 3 * tx.OUT_CHARS
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(i, *c) for i, t in enumerate(texts) if t for c in tx.chunks(t)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")[:-1] != "67108864"
