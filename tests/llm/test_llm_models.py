"""Whitening, language identification and phrases against plain versions, with nulls, empty tables, long texts and further columns."""

import collections
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, phrases, whitening
from graphloom.llm.scratch import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, n string, phrase string"
VEC = "vec_id long, embedding array<float>, label int, x string, component string"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# whitening
def vectors(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], 0, "clash", "clash") for i, v in rows], VEC)


def plain_whitening(x):
    """Distinct rows: n, sums, eigenvalues (falling) and eigenvectors of the covariance, formed from exact fractions."""
    u = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(u), u.sum(axis=0)
    c = n * u - s
    v = np.array([[float(Fraction(int(a), n**3)) for a in row] for row in c.T.dot(c)])
    e, w = np.linalg.eigh(v)
    return n, s, e[::-1], w[:, ::-1]


def test_whitening_is_its_plain_version(spark):
    r = np.random.default_rng(5)
    own = r.normal(size=(300, 6)).astype(np.float32) * [5, 3, 2, 1, 0.5, 0.2] + [1e4, -3, 0, 7, 0, 0]
    rows = [(k if k != 7 else None, v.tolist()) for k, v in enumerate(own)]
    rows += [(1000 + k, own[0].tolist()) for k in range(200)] + [(0, own[0].tolist())]
    odd = [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [math.nan] * 6), (2003, [math.inf] + [0.0] * 5)]
    df = vectors(spark, rows + odd).repartition(9)
    got = whitening.whiten(df, components=4).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows]).astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s, e, w = plain_whitening(x)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), e[:4] / e.sum(), rtol=1e-9)
    want = ((n * x - s) / n).astype(float) @ w[:, :4] / np.sqrt(e[:4])
    mine = got[got["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    at = {i: k for k, (i, _) in enumerate(rows) if i is not None}
    theirs = want[[at[i] for i in mine.index]]
    sign = np.sign((mine.to_numpy() * theirs).sum(axis=0))
    assert np.abs(mine.to_numpy() - theirs * sign).max() < 1e-8
    apart = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s)) for i, k in at.items()}
    assert all(apart[r.vec_id] == r.deviation for r in got[got["vec_id"].notna()].itertuples())


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # one distinct vector has no component
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    # a dimension twice, one without variance, and a short vector: components only where there is variance
    flat = vectors(spark, [(k, [float(k * k % 17), float(k * k % 17), 3.0, float(k % 5)]) for k in range(40)] + [(99, [2.0])])
    got = whitening.whiten(flat).toPandas()
    assert got.groupby("vec_id").size().eq(3).all()  # the short vector adds one direction
    assert got["identity_error"].max() < 1e-6 and abs(got.drop_duplicates("component")["explained"].sum() - 1) < 1e-9
    got = whitening.whiten(flat.where("vec_id < 99")).toPandas()
    assert got.groupby("vec_id").size().eq(2).all()
    # components that 64 bits do not hold are held at the end, and a deviation beyond them is null
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])])).toPandas()
    assert huge["deviation"].isna().any() and np.isfinite(huge["whitened"]).all()


def test_merged_summaries_lose_nothing(spark):
    r = np.random.default_rng(3)
    x = r.integers(-50, 50, (500, 7)) + 1_000_000
    parts = [whitening.Summary.of(p) for p in np.array_split(x, 23)]
    while len(parts) > 1:
        parts = [whitening._rows(parts[k : k + 3]) for k in range(0, len(parts), 3)]
    own, once = whitening.Whitening.of(parts[0]), whitening.Whitening.of(whitening.Summary.of(x))
    assert own.n == 500 and own.sums == once.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(own.values, once.values, rtol=1e-12) and np.allclose(np.abs((own.vectors * once.vectors).sum(axis=0)), 1, atol=1e-12)
    big = np.array([[1 << 59, -(1 << 59)], [3, 4], [-(1 << 59), 1 << 59]])
    assert whitening.Summary.of(big).sums == [3, 4] and whitening.times_n(big, 3, [3, 4])[0][0] == 3 * (1 << 59) - 3


# language
TONGUES = {"aa": "ka lo mi", "bb": "strun grof", "cc": "äöü ßen", "dd": "шта какой", "ee": "a-b c"}


def language_rows(n, seed=2):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(TONGUES))
        parts = TONGUES[lang].split()
        rows.append((k, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang, "s", 0, "c", "c"))
    return rows


def plain_likelihood(word: bytes, p: dict[bytes, float]) -> float:
    """Sum over all segmentations, by trying every one."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        parts, begin = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[begin:i])
                begin = i
        parts.append(word[begin:])
        total += math.prod(p.get(x, 0.0) for x in parts)
    return total


def _pieces_model(seed=1, langs=3):
    pieces = language_id.vocabulary(PATH)
    ends = np.cumsum([len(p) for p in pieces])
    keys = language_id.Rolling(np.frombuffer(b"".join(pieces), np.uint8)).of(ends - [len(p) for p in pieces], ends)
    p = np.random.default_rng(seed).random((len(pieces), langs)) / len(pieces)
    order = np.argsort(keys)
    model = language_id.Model(keys[order], sorted({len(x) for x in pieces}), [f"l{k}" for k in range(langs)], np.vstack([p, np.zeros(langs)]))
    return model, [{pieces[order[i]]: p[i, k] for i in range(len(pieces))} for k in range(langs)]


def test_forward_sums_all_segmentations():
    model, plain = _pieces_model()
    u = language_id.Units(["Hallo die Welt über ÉTÉ", "x1y какой 漢字"])
    got = model.log_likelihood(u.roll, u.starts, u.ends)
    for row, a, b in zip(got, u.starts, u.ends):
        word = bytes(u.data[a:b])
        assert word[:1] == b" "
        if len(word) <= 14:
            assert np.allclose(np.exp(row), [plain_likelihood(word, p) for p in plain], rtol=1e-9, atol=0)


def test_expected_uses_are_those_of_all_segmentations():
    model, plain = _pieces_model(langs=1)
    u, n = language_id.Units(["hallo été"]), np.array([3.0, 2.0])
    got = model.uses(u.roll, u.starts, u.ends, n, 0)
    want, keys = collections.Counter(), {}
    for piece, p in plain[0].items():
        keys[piece] = int(model.find(language_id.Rolling(np.frombuffer(piece, np.uint8)).of(np.array([0]), np.array([len(piece)])))[0])
    for a, b, times in zip(u.starts, u.ends, n):
        word = bytes(u.data[a:b])
        total = plain_likelihood(word, plain[0])
        for cuts in itertools.product([False, True], repeat=len(word) - 1):
            at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(word)]
            parts = [word[x:y] for x, y in zip(at, at[1:])]
            share = math.prod(plain[0].get(x, 0.0) for x in parts) / total
            for x in parts:
                if share:
                    want[keys[x]] += times * share
    assert np.allclose(got[list(want)], list(want.values()), rtol=1e-9) and abs(got.sum() - sum(want.values())) < 1e-9


def test_units():
    texts = ["Don't PANIC: été, 12 ab12cd", "", "...", "漢字かな", "a" * 70]
    u = language_id.Units(texts)
    words = [(int(o), bytes(u.data[a:b]).decode()) for o, a, b in zip(u.owner, u.starts, u.ends)]
    assert words[:7] == [(0, " don"), (0, " t"), (0, " panic"), (0, " été"), (0, " ab"), (0, " cd"), (3, " 漢字かな")]
    assert words[7:] == [(4, " " + "a" * 31), (4, "a" * 32), (4, "a" * 7)]
    groups = list(language_id.stretches(["ab " * 900_000, "x", None]))
    assert "".join(t for at, some in groups for i, t in zip(at, some) if i == 0) == "ab " * 900_000 and all(len(t) <= 1 << 20 for _, some in groups for t in some)


def test_language(spark):
    rows = language_rows(600)
    odd = [(9001, None, "aa"), (9002, "", "bb"), (9003, "12 ... !", "cc"), (None, "kalomi kalo mika", "aa"), (9004, "strungrof " * 150_000, None), (9005, "kalo", "aa"), (9005, "kalo", "aa")]
    df = spark.createDataFrame([*rows, *[(*x, "s", 0, "c", "c") for x in odd]], DOC)
    got = language_id.op12_language(df, PATH).toPandas()
    assert len(got) == len(rows) + len(odd) and list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id}
    held = [(k, lang) for k, _, lang, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 100 and all(by[k].held_out for k, _ in held) and sum(by[k].lang_pred == lang for k, lang in held) >= 0.99 * len(held)
    assert [by[k].lang_pred for k in (9001, 9002, 9003, 9004, 9005)] == ["und", "und", "und", "bb", "aa"] and by[9003].score == 0.0
    assert got["score"].between(0, 1).all() and not got[got["doc_id"].isna()]["held_out"].any()
    again = language_id.op12_language(df.withColumn("source", F.lit("other")), PATH).toPandas().sort_values(["doc_id", "lang_pred"])
    assert np.allclose(again["score"], got.sort_values(["doc_id", "lang_pred"])["score"])
    # what is held out teaches nothing
    unlabelled = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(None)).otherwise(F.col("lang")))
    assert language_id.op12_language(unlabelled, PATH).toPandas().sort_values(["doc_id", "lang_pred"])["lang_pred"].tolist() == again["lang_pred"].tolist()
    assert language_id.op12_language(df.limit(0), PATH).count() == 0
    nobody = language_id.op12_language(df.withColumn("lang", F.lit(None).cast("string")).limit(5), PATH).toPandas()
    assert set(nobody["lang_pred"]) == {"und"} and set(nobody["score"]) == {0.0}


# phrases
def plain_phrases(rows, threshold, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    out = collections.defaultdict(list)
    for (lang, p), a in good.items():
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(x == lang and len(q) > len(p) and inside(q) and 100 * b >= 100 * a for (x, q), b in good.items()):
            continue
        out[lang].append((-score, -a, " ".join(p).encode(), l, r, n[lang]))
    return {(lang, k, p.decode(), -a, l, r, n, -s) for lang, all_ in out.items() for k, (s, a, p, l, r, n) in enumerate(sorted(all_)[:most], 1)}


def phrase_rows(seed=4):
    r = random.Random(seed)
    words = ["the", "of", "The", "été", "a\xa0b", "x-y", "漢", "big", "end", "is"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(r.randint(0, 80)))
    rows = [(r.choice(["en", "fr", None, "und"]), text()) for _ in range(300)]
    return rows + [("en", None), ("en", ""), ("fr", "one same passage of words that all share"), *[("en", "one same passage of words that all share")] * 12, ("de", "..!"), ("xx", "word")]


def test_phrases_are_the_plain_ones(spark):
    rows = phrase_rows()
    df = spark.createDataFrame([(None if k % 7 == 0 else k % 50, t, lang, "s", 0, "c", "c") for k, (lang, t) in enumerate(rows)], DOC).repartition(5)
    for threshold, most in ((10, 2000), (3, 25)):
        got = {tuple(r) for r in phrases.collocations(df, threshold=threshold, most=most).collect()}
        assert got == plain_phrases(rows, threshold, most)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.where("lang = 'xx'")).count() == 0


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = " ".join(f"w{k % 13}{'.' if k % 9 == 0 else ''}" for k in range(400)).encode()
    whole = collections.Counter()
    for words, at, n, _ in phrases.counted(t := phrases.Tokens(text), 1, {}, 5):
        whole.update(dict(zip(t.texts(at, words).to_pylist(), n.tolist())))
    for size in (7, 40, 333):
        monkeypatch.setattr(phrases, "STRETCH", size)
        parts, total = collections.Counter(), 0
        for buffer, cut in phrases.buffers([text, b"", b"w1 w2"[:0]]):
            t = phrases.Tokens(buffer, cut)
            total += t.limit
            for words, at, n, _ in phrases.counted(t, 1, {}, 5):
                parts.update(dict(zip(t.texts(at, words).to_pylist(), n.tolist())))
        assert total == 400 and parts == whole


def test_sketch_never_counts_less(spark):
    rows = [("en", "a b c d e f " * 30)] * 20 + [("fr", "a b. c d")] * 7
    df = spark.createDataFrame(rows, "lang string, t string").repartition(6)
    sketch = phrases._broadcast(phrases._sketch(df, {}, range(1, 3), 100))
    bits, t = phrases.Bits(sketch.value), phrases.Tokens(b"a b c d e f a zz zz")
    passed = {x: ok for words, at, _, h in phrases.counted(t, phrases._seed("en"), {}, 2) for x, ok in zip(t.texts(at, words).to_pylist(), bits.may_be(h).tolist())}
    assert all(ok for x, ok in passed.items() if "zz" not in x) and not passed["zz"] and not passed["zz zz"]
    assert not bits.may_be(t.hash(np.array([0]), 2, phrases._seed("fr"))).any()


def test_score_is_exact(spark):
    a, n, l, r = 10**14 + 7, 9 * 10**17 + 1, 10**16 + 3, 10**15 + 9
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(phrases._score("a", "n", "l", "r")).first()[0] == 1000 * a * n // (l * r)


@pytest.mark.parametrize("threshold", [5])
def test_frequent_holds_all_parts(spark, threshold):
    df = spark.createDataFrame([(lang, t, "s") for lang, t in phrase_rows(9)], "lang string, text string, f string")
    found = {(r["lang"], r["phrase"]): r["f"] for r in phrases.frequent(df, Scratch(spark, "t"), threshold=threshold).collect()}
    for (lang, p), f in found.items():
        words = p.split(" ")
        if len(words) > 1:
            assert found[lang, " ".join(words[1:])] >= f and found[lang, " ".join(words[:-1])] >= f
