"""Suffix and near-duplicate dedup, mixing, top-k, WARC and the pipeline against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import components, mixing, near_dedup, suffix_dedup, textkit, topk, warc
from graphloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice(["an", "the", "ré", "on", "ti", "er", "mo"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def covered(symbols, all_symbols, length):
    """Which symbols are in a string of this length that is there more than once, of each text."""
    count = collections.Counter(t[i : i + length] for t in all_symbols for i in range(len(t) - length + 1))
    out = []
    for t in symbols:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def plain_repeats(texts, length=400):
    out, words = [], [tuple(WORD.findall(t.decode())) for t in texts]
    for t, gone, far in zip(texts, covered(texts, texts, length), covered(words, words, 51)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), int(far.sum())))
    return out


@pytest.fixture(scope="module")
def repeat_texts():
    r = random.Random(1)
    passage, long_ = prose(r, 90), prose(r, 400)
    texts = [prose(r, 150) + " " + passage + " " + prose(r, 60), passage, passage[:-3] + "zz", prose(r, 50) + passage[20:450], long_, long_, long_[:700] + "X" + long_[701:], long_[300:1200], "", "ab", None]
    texts += ["abcdefg" * 300, "a" * 1500, "b" * 401, "c" * 400, prose(r, 100), long_[500:1000] + prose(r, 20) + long_[100:600]]
    texts += ["é" * 150 + "à" * 250, "è" * 150 + "à" * 250]
    return texts


def test_suffix(spark, repeat_texts, monkeypatch):
    texts = repeat_texts
    df = frame(spark, [(k if k != 3 else None, t, "s") for k, t in enumerate(texts)])
    want = collections.Counter(plain_repeats([(t or "").encode() for t in texts]))
    key = lambda r: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passage_words"])
    assert collections.Counter(map(key, suffix_dedup.substring_report(df).collect())) == want
    # Repeated rows repeat each other.
    twice = df.where("doc_id = 15").unionByName(df.where("doc_id = 15"))
    assert all(r["n_removed"] == r["n_bytes"] for r in suffix_dedup.substring_report(twice).collect())
    assert suffix_dedup.substring_report(df.limit(0)).count() == 0
    out = suffix_dedup.without_repeats(df.withColumn("kept", F.lit(1)))
    assert out.columns == [*df.columns, "kept"] and out.count() == len(texts)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[10] is None and rows[15] == texts[15] and rows[4] == "" and "�" not in "".join(t or "" for t in rows.values())


@pytest.mark.parametrize("length", [51, 400])
def test_suffix_words(spark, repeat_texts, length):
    """Passages of words are cut wherever they are, with the white space behind each word; shorter ones stay."""
    r = random.Random(21)
    words = prose(r, 1200).split()
    passages = {n: words[100 + n : 100 + 2 * n] for n in (49, 50, 51, 52, 60, 399, 401)}
    texts = list(repeat_texts) + [" ".join(words[600:])]
    for n, own in passages.items():
        for gap in ("  ", "\n"):
            texts.append(prose(r, 30) + "\n" + gap.join(own) + " " + prose(r, 20) + " \n")
    df = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    unit = suffix_dedup.Unit(True, length, 500)
    got = {x["doc_id"]: x["text"] for x in suffix_dedup.without_repeats(df, unit).collect()}
    split = [tuple(WORD.findall(t or "")) for t in texts]
    for k, (t, gone) in enumerate(zip(texts, covered(split, split, length))):
        if t is None:
            assert got[k] is None
            continue
        at, want, last = [m.span() for m in WORD.finditer(t)], "", 0
        for i, (a, b) in enumerate(at):
            if gone[i]:
                want += t[last:a]
                last = at[i + 1][0] if i + 1 < len(at) else b
        assert got[k] == want + t[last:]
    first = len(repeat_texts) + 1
    if length == 51:
        assert got[first] == texts[first] and " ".join(passages[51][:3]) not in got[first + 4] and len(got[first + 4]) < len(texts[first + 4])
    assert suffix_dedup.without_repeats(df.limit(0), unit).count() == 0


def test_word_arrays():
    """A long text is read in stretches and has the words of the whole."""
    texts = [prose(random.Random(22), 3000).encode(), b"", b" a  b\t", ("x" * 5000).encode(), b"a b"]
    whole, cut = list(textkit.word_arrays(texts)), list(textkit.word_arrays(texts, 1000))
    for t, x, y in zip(texts, whole, cut):
        assert all(np.array_equal(a, b) for a, b in zip(x, y))
        assert [t[a:b] for a, b in zip(*x[1:])] == t.split()
    assert whole[2][0].tolist() == whole[4][0].tolist() and not len(whole[1][0])


@pytest.mark.parametrize("words", [False, True])
def test_suffix_pieces(words):
    """Pieces of a long text have the same anchors' strings as the whole."""
    unit, text = suffix_dedup.Unit(words, 60 if words else 400, 700), prose(random.Random(2), 3000 if words else 900).encode()
    starts = []
    for s in suffix_dedup.slices([b"x" * 10, text], unit, unit.length):
        _, _, part, pos = suffix_dedup.anchors(s, unit)
        first, count, _ = suffix_dedup.unpack(pos)
        starts += [x for a, n in zip(first, count) for x in range(a, a + n)]
    assert sorted(starts) == list(range((3000 if words else len(text)) - unit.length + 1))
    with pytest.raises(ValueError):
        suffix_dedup.Unit(words, 3)


def test_multikey():
    r = np.random.default_rng(1)
    tokens = [r.integers(0, n, 500) for n in (20, 5, 3)]
    order = suffix_dedup.multikey(*tokens)
    assert np.array_equal(np.stack(tokens)[:, order], np.stack(tokens)[:, np.lexsort(tokens[::-1])])


def test_suffix_boundaries(spark, monkeypatch):
    """Equal suffixes on both sides of a boundary of buckets, of groups of buckets, and of empty buckets."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    rows = [(b, p, c, h, 0, 0, b * 10 + p, 0) for b, p, c, h in [(0, 0, 1, 1), (0, 5, 2, 2), (1, 0, 2, 2), (1, 3, 3, 1), (4, 0, 3, 2), (4, 1, 4, 1), (7, 0, 5, 1)]]
    got = suffix_dedup._across(spark.createDataFrame(rows, "bucket int, place long, core long, hull long, rk long, rk2 long, pos long, level int")).collect()
    assert {x["pos"]: x["level"] for x in got} == {0: 0, 5: 3, 10: 3, 13: 1, 40: 1, 41: 0, 70: 0}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets, up = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(sets[k]), least[root(k)]) for k, (i, _, _) in enumerate(rows) if i is not None}


def near_rows():
    r = random.Random(5)
    rows, base = [], [prose(r, n).split() for n in (12, 60, 200, 30)]
    for words in base:
        for _ in range(40):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                own[r.randrange(len(own))] = prose(r, 1)
            rows.append(" ".join(own).capitalize())
    rows += ["one two three", "One TWO three", "one two", "", None, " \n ", "x"] + [prose(r, 20000)] + [prose(r, 40) for _ in range(60)]
    r.shuffle(rows)
    return [(k, t, "s") for k, t in enumerate(rows)]


def test_near(spark, monkeypatch):
    rows = near_rows()
    df = frame(spark, rows)
    got = near_dedup.near_components(df.withColumn("node", F.lit("clash"))).collect()
    want = plain_components(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    one = near_dedup.one_of_each(df.unionByName(df.limit(5)))
    assert one.columns == df.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert near_dedup.near_components(df.limit(0)).count() == 0
    odd = frame(spark, [(None, rows[0][1], "s"), (None, rows[0][1], "s"), (4, "lone text of five words", "s")])
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(odd).collect()} == {(None, None, True), (4, 4, True)}
    assert near_dedup.one_of_each(odd).count() == 2


def test_register_estimate():
    r = np.random.default_rng(2)
    all_ = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(all_[:2000]), np.unique(all_[:2000].tolist() + all_[2000:2100].tolist()).astype(np.uint64), np.unique(all_[1000:])]
    codes = near_dedup.registers(sets)
    assert near_dedup.may_link(codes[0], codes[1], 85) and not near_dedup.may_link(codes[0], codes[2], 85)
    assert (near_dedup.band_keys(codes)[0] == near_dedup.band_keys(codes)[1]).any()
    empty = near_dedup.registers([np.array([5], np.uint64)])
    assert (empty != near_dedup.EMPTY).sum() == 1 and len(set(near_dedup.band_keys(empty)[0])) == near_dedup.BANDS


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "c")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {i: root(i) for a, b in pairs if a != b for i in (a, b)}


def test_mixing(spark):
    r = random.Random(4)
    rows = [(k, prose(r, r.choice([5, 20, 60])), s) for k, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["tiny"] * 4 + [None] * 30)] + [(900, None, "void"), (901, "", "void"), (None, "a b c", "mid"), (5, rows_text := "same same", "mid"), (5, rows_text, "mid")]
    df = frame(spark, rows).withColumn("m_key", F.lit("clash"))
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows) and "m_key" in plan[0].asDict()
    by = collections.defaultdict(list)
    for x in plan:
        by[x["source"]].append(x)
    sizes = {s: sum(x["size"] for x in v) for s, v in by.items()}
    names = sorted(s for s in sizes if s is not None) + [None]
    weights = dict(zip(names, itertools.cycle((3, 1, 2))))
    targets, open_, rest = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:  # deal the excess out again
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            targets |= {s: level * weights[s] for s in open_}
            break
        for s in over:
            targets[s] = 2 * sizes[s]
            rest -= targets[s]
        open_ -= over
    for s, v in by.items():
        assert v[0]["target"] == pytest.approx(targets[s]) and v[0]["source_size"] == sizes[s]
        taken = sum(x["size"] * x["copies"] for x in v)
        assert abs(taken - targets[s]) <= max((x["size"] for x in v), default=0) and max(x["copies"] for x in v) <= 2
    # Buckets are even for the least weight and at most four times as full for the largest.
    keys = spark.range(40000).select((F.col("id") % 2).alias("light"), (-F.log((F.hash("id").cast("double") + 2.0**31 + 0.5) / 2.0**32) / F.when(F.col("id") % 2 == 0, 1.0).otherwise(mixing.LEAST_WEIGHT)).alias("m_key"))
    full = keys.groupBy("light", mixing._bucket(F.lit(100.0)).alias("b")).count().groupBy("light").agg(F.max("count").alias("n"), F.max("b").alias("b")).collect()
    assert all(x["b"] <= 99 and x["n"] < (300 if x["light"] else 1000) for x in full)
    again = {(x["doc_id"], x["text"]): x["copies"] for x in mixing.mix_plan(df.repartition(7)).collect()}
    assert again == {(x["doc_id"], x["text"]): x["copies"] for x in plan}
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(x["copies"] for x in plan)
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_topk(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.normal(size=(700, 8)).round(2)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(base)] + [(k, [0.5] * 8) for k in range(700, 800)] + [(800, None), (900, [1.0, None]), (1000, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, [1.0] * 8), (1200, [3.0]), (1300, []), (5, [0.1] * 8)]
    rows += [(1400, [2.0**60] * 8)]
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "ROOTS", 3)
    monkeypatch.setattr(topk, "FIRST", 1)
    monkeypatch.setattr(topk, "GROWTH", 2)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, id string")
    got = collections.defaultdict(list)
    for x in topk.op8_topk(df).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["score"], x["vec_id"]))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    queries = {i: v for i, v in good if i % 100 == 0}
    assert set(got) == set(queries)
    for i, q in queries.items():
        want = sorted(((clip(sum(a * b for a, b in zip(q, v))), j) for j, v in good if j != i), key=lambda x: (-x[0], x[1]))[:10]
        assert got[i] == want
    assert topk.op8_topk(df.limit(0)).count() == 0
    few = df.where("vec_id in (100, 3, 4)")
    assert topk.op8_topk(few).count() == 2


def test_topk_prunes_shards_of_clustered_vectors(spark, monkeypatch):
    """Of vectors in groups, under a third of the pairs of a block and a shard are searched, and the result is that of all."""
    r = np.random.default_rng(11)
    centres = r.normal(size=(24, 12)) * 10
    base = np.concatenate([c + r.normal(size=(90, 12)) * 0.3 for c in centres] + [np.repeat(centres[:1], 700, axis=0)])  # and a third are one vector
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(r.permutation(len(base)), base)]
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 4), ("LEAF", 8), ("FIRST", 1), ("GROWTH", 2), ("ROOTS", 7)):
        monkeypatch.setattr(topk, name, value)
    df, stats = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), stats=stats).collect()
    assert stats["searched"] < stats["pairs"] / 3
    ids, whole = np.array([i for i, _ in rows]), np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for i, q in zip(ids, whole):
        if i % 100 == 0:
            best = sorted((-int(s), int(j)) for s, j in zip(whole @ q, ids) if j != i)[:10]
            want += [(int(i), k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    same, small = "<p>é" + "x" * 2000, "y" * 999
    rows = [(k, f"http://www.site{k % 3}.example.com/p/{k}?q=1#f", same if k % 4 == 0 else small if k % 4 == 1 else f"<html>{k}" + "z" * (k * 90)) for k in range(40)]
    rows += [(None, None, same), (100, "not a url", None), (101, "http://h/\r\nx", "\r\n\r\nbody"), (None, "http://a", "w" * 1200), (None, "http://b", "w" * 1200)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.op10_warc(df).collect()
    last = max(i for i, _, h in rows if h == same and i is not None)
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == same and i != last
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    folder = Scratch(spark, "w").path("a")
    warc.write_archive(df, folder)
    for i, url, h in rows[:6]:
        (head, http, payload), *more = warc.look_up(spark, folder, url)
        assert not more and head["X-Page-Id"] == str(i) and (payload.decode() == h if head["WARC-Type"] == "response" else payload == b"")
        if head["WARC-Type"] == "revisit":
            [(first, _, _)] = warc.look_up(spark, folder, rows[last][1])
            assert head["WARC-Refers-To"] == first["WARC-Record-ID"] and head["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"] == rows[last][1]
    assert zlib.decompress(warc.info("a.warc.gz"), 31).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert warc.look_up(spark, folder, "http://nowhere.example.com/") == []
    assert warc.surt("HTTP://Blog.X.example.com:8080/a?b#c") == "com,example,x,blog:8080)/a?b"
    assert warc.op10_warc(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    r = random.Random(6)
    passage = prose(r, 100)
    rows = [(k, prose(r, 80), f"s{k % 3}") for k in range(80)]
    rows += [(100, rows[0][1], "s1"), (101, rows[1][1] + " tail", "s1"), (102, prose(r, 60) + " " + passage, "s2"), (103, prose(r, 60) + " " + passage, "s2"), (104, "scoundrel " * 30, "s0"), (105, None, None)]
    rows += [(200 + k, prose(r, 60) + " scoundrel wretch", "s1") for k in range(30)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int("scoundrel" in (t or "")), 1) for i, t, _ in rows]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(df.columns == columns for name, df in seen.items() if name != "bpe")
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in seen.items()}
    assert 104 not in ids["toxicity"] and set(range(80)) | {105} <= ids["toxicity"]
    assert not {100, 101} & ids["near_duplicates"] and {0, 1, 105} <= ids["near_duplicates"]
    assert ids["suffix_array"] == ids["near_duplicates"]
    cut = {r["doc_id"]: r for r in seen["suffix_array"].collect()}
    assert passage not in cut[102]["text"] and cut[102]["n_chars"] == len(cut[102]["text"]) and cut[2]["text"] == rows[2][1]
    assert collections.Counter(r["doc_id"] for r in seen["bpe"].collect()) == collections.Counter(r["doc_id"] for r in seen["mixing"].collect())
    assert sorted(r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["n_tokens"] for r in seen["bpe"].collect())


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    """What a stage has nothing of, it gives nothing of, with the same columns."""
    none = frame(spark, [(1, "a b c", "s")]).where("doc_id < 0")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.columns == none.columns)


def test_pipeline_drops_near_copies_from_080(spark, tmp_path):
    """The stage of near-duplicates drops copies whose Jaccard index is 0.80 to 0.85."""
    r = random.Random(8)
    rows, far = [], set()
    for k in range(40):
        words = [f"{w}{i}" for i, w in enumerate(prose(r, 200).split())]
        copy = list(words)
        for at in (30, 80, 130, 170)[: 4 if k % 2 else 3]:  # five shingles each: 176 / 216 and 181 / 211
            copy[at] = "other"
        copy = copy + [f"tail{i}" for i in range(0 if k % 2 else 6)]
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        assert 0.80 <= len(a & b) / len(a | b) < 0.85
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(copy), "s")]
    for k in (100, 102):  # six words changed: 166 / 226
        words = [f"{w}{i}" for i, w in enumerate(prose(r, 200).split())]
        copy = ["other" if i in (20, 50, 80, 110, 140, 170) else w for i, w in enumerate(words)]
        rows += [(k, " ".join(words), "s"), (k + 1, " ".join(copy), "s")]
        far |= {k, k + 1}
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert {x["doc_id"] for x in out.collect()} == set(range(0, 80, 2)) | far
