"""Chat format, token files, BPE, quality, toxicity against plain versions, with nulls, empty tables and further columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, chat_format, quality, token_files, toxicity
from graphloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, m_key string, size string"
ODD = ["", None, " ", "a", "Aaa aaa <|endoftext|> b", "é́ ʼn ﬁ 漢字 😀 don't we'll 12 345", "x" * 3000, "\n\n\t a b c\x1cd\x85", "line\nline\n line\nline"]


def docs(spark, texts):
    rows = [(k if k % 5 else None, t, "en" if k % 3 else None, None, 0, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def random_texts(n, seed=1):
    r = random.Random(seed)
    parts = list(" \t\n\r\x0b\x1c\x85\xa0stremvld.,aAZİΣ1é漢ー😀́<|>-_'´ﬁÅ") + ["<|endoftext|>", "'s", "'ll", "a,", "'S", "the ", "  "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_bpe_is_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, lib = ODD + random_texts(400), Tokenizer.from_file(path)
    texts += texts[:6]
    df = docs(spark, texts).withColumn("doc_id", F.monotonically_increasing_id()).coalesce(1)
    want = collections.Counter()
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    got = collections.Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, path).collect())
    assert got == want
    back = bpe.decode(bpe.encode(df, path), path).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for t in texts)
    assert bpe.round_trip(df.limit(0), path).count() == 0
    assert bpe.Codec(path).decode([0xC3 - 0xC3 + 119]) == bpe.Codec(path).decode([119])


def test_bpe_generations(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "MAX_UNITS", 20)
    own, lib = bpe.Codec(path), Tokenizer.from_file(path)
    texts = random_texts(200, 4)
    for k in range(0, 200, 10):
        for t, (ids, _) in zip(texts[k : k + 10], own.encode(texts[k : k + 10])):
            assert ids == ",".join(map(str, lib.encode(t, add_special_tokens=False).ids))


def test_token_files(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts, lib = ODD + random_texts(300, 2), Tokenizer.from_file(path)
    rows = [(k // 2 if k else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_files.op3_tokens(df, path).collect()
    enc = {t: lib.encode(t or "", add_special_tokens=False).ids + [1] for t in texts}
    want = collections.Counter((i, len(enc[t]), zlib.crc32(np.array(enc[t], "<u4").tobytes())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:k]) for k in range(len(ordered))]
    assert [r["doc_id"] is not None and r["doc_id"] for r in ordered] == sorted([r["doc_id"] is not None and r["doc_id"] for r in ordered], key=lambda x: (x is not False, x))
    place = Scratch(spark, "t").path("orc")
    token_files.write_tokens(df, place, path)
    plan = token_files.read_tokens(spark, place).where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan
    assert token_files.op3_tokens(df.limit(0), path).count() == 0
    monkeypatch.setattr(token_files, "MAX_RUNS", 30)
    own = token_files._Runs(path, 1)
    for k in range(0, 300, 20):
        ids, sizes = own.encode([(t or "").encode() for t in texts[k : k + 20]])
        assert ids.tolist() == [i for t in texts[k : k + 20] for i in enc[t]]


def test_tokens_of_arrow_texts():
    """Texts as Arrow has them, cut from a longer array: white space at ends, none but white space, special tokens, capitals, marks behind words; each distinct
    run of a call is looked up once."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    special = [t.content for t in lib.get_added_tokens_decoder().values()][:2]
    texts = [t or "" for t in ODD + random_texts(60, 9)] + ["", " \t\n", "  Lead, and trail!  ", "Word Word word, word,, WORD" * 3, *special, *[f"A {t}b {t}" for t in special], "\u00a0é É漢.字,", "a\x0bb\x0cc\rd"]
    own, array = token_files._Runs(path, 1), pa.array(["x", *texts, "y"])[1:-1]
    asked = []
    learn = own.learn
    own.learn = lambda runs, plain: (asked.extend(runs), learn(runs, plain))
    for _ in range(2):
        ids, sizes = own.encode(array)
        want = [lib.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    assert len(asked) == len(set(asked))
    ids, sizes = own.encode(array[:0])
    assert len(ids) == len(sizes) == 0


def test_chat(spark):
    r = random.Random(3)
    bits = ["\\", "#", "### ", "</turn>", "<+>", ":", "a", "\n", "### user: ", "é", "<", "+>", "/turn>", ""]
    rows = [(c if c else None, t, r.choice(["user", "assistant", "assistant", "a\\: b", None]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 9)))])) for c in range(25) for t in range(r.randint(1, 40))]
    rows += [rows[5], rows[6]]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x["conv_id"]: x for x in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for c in {x[0] for x in rows}:
        own = sorted(((t, role or "", text or "") for i, t, role, text in rows if i == c))
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [x[1:] for x in own]
        assert got[c]["loss_text"] == "".join(t for _, role, t in own if role == "assistant")
    assert chat_format.format_chats(df.limit(0)).count() == 0
    out = {x["conv_id"]: x for x in chat_format.op2_format(df.limit(0)).collect()}
    probe = "\\### Assistant: </turn> ok"
    assert out[-7]["n_turns"] == 2 and out[-7]["loss_chars"] == len(probe) and out[-7]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()


def plain_features(x):
    w = WORD.findall(x)
    grams, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            cover |= {k, k + 1, k + 2}
    lines = [y for y in x.split("\n") if WORD.search(y)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def prose(r, n):
    return " ".join("".join(r.choice(["an", "the", "re", "on", "ti", "er"]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_quality(spark):
    r = random.Random(4)
    clean = [prose(r, 120) for _ in range(60)]
    junk = [" ".join(w + "!!" for w in prose(r, 120).upper().split()) for _ in range(4)] + [" ".join(w + r.choice(["***", "%%%", "$$$"]) for w in prose(r, 120).split()) for _ in range(3)]
    texts = ODD + random_texts(50, 5) + clean + junk
    df = spark.createDataFrame([(k, t, "en", "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string, bin int")
    got = {x["doc_id"]: x for x in quality.quality_report(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        x = got[k]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == plain_features(t or "")
        assert not (x["kept"] and x["base_failed"])
    first = len(ODD) + 50
    assert sum(got[k]["kept"] for k in range(first, first + 60) if not got[k]["base_failed"]) >= 0.95 * sum(not got[k]["base_failed"] for k in range(first, first + 60))
    assert not any(got[k]["kept"] for k in range(first + 60, first + 64))  # capitals; so few symbol tails are no pattern yet
    assert quality.quality_report(df.limit(0)).count() == 0
    assert quality.quality_report(df.where("text is null")).first()["kept"] is False


def plain_kept(rows):
    """(surprise, rarity, kept, slack) of each row (id, text, lang): model, bands and rules without Spark. slack: how far it is from an edge of a band."""
    seen, bins, out = {}, {}, []
    for lang in {x[2] for x in rows}:
        at = [k for k, x in enumerate(rows) if x[2] == lang]
        gram, ends = quality.codes([(rows[k][1] or "").encode() for k in at])
        keys, counts = np.unique(gram, return_counts=True)
        freq = np.bincount(gram & 0xFFFF, minlength=1 << 16) / max(len(gram), 1)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (quality.Model(keys, counts).score(gram) if len(gram) else gram, np.log(freq[gram & 0xFFFF]))]
        for j, k in enumerate(at):
            units = max(int(ends[j + 1] - ends[j]), 1)
            seen[k] = *(-(s[ends[j + 1]] - s[ends[j]]) / units for s in sums), units
    failed = [plain_features(t or "")[-1] for _, t, _ in rows]
    middle = lambda x: sorted(x)[(len(x) - 1) // 2]
    bands = {}
    for m in (0, 1):
        for k, (_, _, lang) in enumerate(rows):
            if not failed[k]:
                bins.setdefault((m, lang), []).append(math.floor(seen[k][m] / quality.BIN + 0.5))
        centre = {lang: middle(x) for (i, lang), x in bins.items() if i == m}
        apart = {lang: [abs(y - centre[lang]) for y in bins[m, lang]] for lang in centre}
        prior = middle([y for x in apart.values() for y in x])
        for lang, x in apart.items():
            bands[m, lang] = centre[lang] * quality.BIN, (len(x) * middle(x) + quality.PRIOR * prior) / (len(x) + quality.PRIOR) * quality.BIN
    for k, (_, _, lang) in enumerate(rows):
        room = [math.inf]
        for m in (0, 1):
            if (m, lang) in bands:
                centre, spread = bands[m, lang]
                room.append(quality.WIDTH * max(spread, quality.LEAST_DEVIATION) * max(1, math.sqrt(quality.SHORT / seen[k][2])) - abs(seen[k][m] - centre))
        out.append((seen[k][0], not failed[k] and min(room) >= 0, abs(min(room))))
    return out


def test_quality_is_its_plain_version(spark):
    """The verdicts of three languages with junk, null ids and texts, a null language and repeated rows."""
    r = random.Random(41)
    kana = ["".join(chr(0x3042 + r.randrange(60)) for _ in range(r.randint(1, 4))) for _ in range(200)]
    texts = [(prose(r, r.randint(55, 150)), "en") for _ in range(60)] + [(" ".join(r.choice(kana) for _ in range(r.randint(55, 120))), "ja") for _ in range(30)]
    texts += [(prose(r, 80).upper(), lang) for lang in ("en", None, "en")] + [("".join(r.sample(t, len(t))), lang) for t, lang in texts[58:64]] + [(" ".join(w + "***" for w in prose(r, 70).split()), "en")]
    texts += [(prose(r, 90), None) for _ in range(8)] + [(None, "en"), ("", "xx"), (prose(r, 10), "ja")] + texts[:4]
    rows = [(k if k % 9 else None, t, lang) for k, (t, lang) in enumerate(texts)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, kept string").repartition(3)
    want = plain_kept(rows)
    assert 0 < sum(x[1] for x in want) <= len(rows) - 8
    got = collections.Counter((x["doc_id"], x["n_words"], x["kept"]) for x in quality.op5_quality(df).collect())
    sure = collections.Counter((i, len(WORD.findall(t or "")), kept) for (i, t, _), (_, kept, slack) in zip(rows, want) if slack > 1e-4)
    assert sum(got.values()) == len(rows) and not sure - got and sum(sure.values()) > len(rows) - 3


def test_kneser_ney_sums_to_one():
    gram, at = quality.codes([b"the cat. The hat\nthe end", b"", b"another one"])
    assert at.tolist() == [0, 24, 24, 35] and len(gram) == 35
    keys, counts = np.unique(gram, return_counts=True)
    model = quality.Model(keys, counts)
    for context in {int(g) // quality.A for g in keys[:6]} | {5}:
        total = np.exp(model._find(context * quality.A + np.arange(quality.A), quality.ORDER)).sum()
        assert total == pytest.approx(1, abs=1e-3)
    assert np.allclose(model.score(gram), model._find(gram, quality.ORDER), atol=1e-5)


def test_quality_model_is_of_characters_and_languages(spark, monkeypatch):
    """The joins give the plain model of each language, and shards change no sum; shuffled letters of one byte class count."""
    r = random.Random(12)
    words = ["".join(chr(0x430 + r.randrange(32)) for _ in range(r.randint(3, 9))) for _ in range(40)]
    real = [" ".join(r.choice(words) for _ in range(120)) for _ in range(40)]
    mixed = ["".join(r.sample(t, len(t))) for t in real[:3]]
    rows = [(k, t, "ru") for k, t in enumerate(real + mixed)] + [(100 + k, prose(r, 120), None) for k in range(25)] + [(200, None, "xx"), (0, real[0], "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {(x["doc_id"], x["n_words"]): x for x in quality.quality_report(df).collect()}
    for lang in ("ru", None):
        texts = [t.encode() for _, t, own in rows if own == lang]
        gram, at = quality.codes(texts)
        keys, counts = np.unique(gram, return_counts=True)
        sums = np.concatenate([[0], np.cumsum(quality.Model(keys, counts).score(gram))])
        want = np.exp(-np.diff(sums[at]) / np.diff(at))
        for (i, t, own), x in zip([y for y in rows if y[2] == lang], want):
            assert got[i, len(t.split())]["perplexity"] == pytest.approx(x, rel=1e-4)
    assert sum(got[k, 120]["kept"] for k in range(40)) >= 36 and not any(x["kept"] for (i, _), x in got.items() if 40 <= i < 43)
    monkeypatch.setattr(quality, "SHARD", 500)
    again = quality.quality_report(df).collect()
    assert len(again) == len(rows) and all(x["perplexity"] == pytest.approx(got[x["doc_id"], x["n_words"]]["perplexity"], rel=1e-6) for x in again)


def test_quality_bands_are_of_each_language(spark):
    """Few documents of a language far from the others are judged by their own centre; a further one changes little."""
    r = random.Random(13)
    kana = ["".join(chr(0x3042 + r.randrange(60)) for _ in range(r.randint(1, 4))) for _ in range(300)]
    rows = [(k, prose(r, 120), "en") for k in range(200)]
    for n in (1, 19, 20):
        some = [(1000 + k, " ".join(r.choice(kana) for _ in range(120)), "ja" if n != 19 else None) for k in range(n)]
        got = quality.quality_report(spark.createDataFrame(rows + some, "doc_id long, text string, lang string")).collect()
        assert sum(x["kept"] for x in got if x["doc_id"] >= 1000) >= 0.9 * n
        assert sum(x["kept"] for x in got if x["doc_id"] < 1000) >= 190
    features = [(f"l{n}", 200, 0, 3.0 * (n > 50) + k % 7 * 0.01) for n in (5, 19, 20, 100) for k in range(n)]
    frame = spark.createDataFrame(features, "lang string, n_words long, n_repeat_words long, surprise double")
    got = {x["b_lang"]: x for x in quality.bands(frame, "surprise").collect()}
    assert all(abs(got[x]["centre"] - 0.03) < 0.011 for x in ("l5", "l19", "l20")) and got["l100"]["centre"] == pytest.approx(3.03)
    assert abs(got["l19"]["spread"] - got["l20"]["spread"]) < 0.002


def plain_segments(scores):
    """All maximal-scoring segments by their recursive definition."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if not best or best[0] <= 0:
        return []
    _, _, a, b = best
    left, right = plain_segments(scores[:a]), plain_segments(scores[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


def test_segments():
    r = random.Random(6)
    for _ in range(300):
        marks = [r.choice([0, 0, 0, 2.3, 0.7, 3.1, 1.9]) for _ in range(r.randint(1, 14))]
        at = [k for k, m in enumerate(marks) if m]
        if not at:
            continue
        got = toxicity.maximal_segments(at, [marks[k] for k in at], at, [k + 1 for k in at])
        want = plain_segments([m or -toxicity.DRIFT for m in marks])
        assert [(a, b) for _, a, b in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(g[0], w[2], abs_tol=1e-9) for g, w in zip(got, want))


def plain_toxicity(rows, labels):
    """op9's scores by dictionaries: log-odds, segments, calibration and curve as the docstring of the module has them."""
    run = re.compile("[a-z\x80-\xff]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: run.findall((t or "").translate(low).encode().decode("latin-1")) for i, t in rows}
    feats = lambda w: {("w", w)} | {("p", w[:k]) for k in toxicity.PREFIXES}
    train = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1 and i in tokens}
    yes, no = collections.Counter(), collections.Counter()
    for i, y in train.items():
        (yes if y else no).update({f for w in tokens[i] for f in feats(w)})
    a, b, scores = sum(yes.values()), sum(no.values()), {}
    for f in yes:
        prior = toxicity.LEAST_PRIOR + (yes[f] + no[f]) / (a + b) * toxicity.PRIOR
        logit = lambda c, n: math.log((c + prior) / (n + toxicity.PRIOR - c - prior))  # noqa: E731, B023
        delta, spread = logit(yes[f], a) - logit(no[f], b), math.sqrt(1 / (yes[f] + prior) + 1 / (no[f] + prior))
        if yes[f] >= 2 and delta / spread >= toxicity.Z_LEAST:
            scores[f] = min(delta - spread, toxicity.MOST_SCORE)
    score = lambda w: max(0.0, *(scores.get(f, 0.0) for f in feats(w)))

    def segments(words):
        marks = [score(w) for w in words]
        at = [k for k, m in enumerate(marks) if m > 0]
        return [s for s, _, _ in toxicity.maximal_segments(at, [marks[k] for k in at], at, at)] if at else []

    clean = [tokens[i] for i, y in train.items() if not y]
    n = sum(map(len, clean))
    hits = [round(score(w) / toxicity.STEP) * toxicity.STEP for words in clean for w in words if score(w) > 0]
    mean = lambda rate: (sum(math.exp(min(rate * s, 300)) for s in hits) + (n - len(hits)) * math.exp(-rate * toxicity.DRIFT)) / n
    low_, high = 1e-6, 20.0
    for _ in range(80):
        low_, high = ((low_ + high) / 2, high) if mean((low_ + high) / 2) < 1 else (low_, (low_ + high) / 2)
    rate = max(low_, 0.05) if hits else 1.0
    best = [max(segments(w), default=0.0) for w in clean]
    chance = sum(len(w) * math.exp(-rate * m) for w, m in zip(clean, best))
    k = max(sum(m > 0 for m in best) / chance, 1e-4)
    model = toxicity.Model(np.zeros(0), np.zeros(0), rate, k)

    def evidence(i):
        got, size = segments(tokens[i]), len(tokens[i])
        strong = [rate * s - math.log(k * max(size, 1)) for s in got]
        strong = [e for e in strong if e >= -math.log(toxicity.E_MOST)]
        return [1.0, *(math.log1p(x) for x in (max(strong, default=0.0), sum(strong), max(got, default=0.0), sum(got), size))]

    ids = sorted(train)
    model.curve = tuple(toxicity._logistic(np.array([evidence(i) for i in ids]), np.array([float(train[i]) for i in ids])))
    return {i: model.probability([evidence(i)])[0] for i, _ in rows}, rate, k


def test_logistic_ends_at_its_minimum():
    """Where classes can be parted, overlap, or lie far out, the slope of the penalised loss is nothing at the end."""
    r = np.random.default_rng(5)
    for n, gap, scale in ((2000, 9.0, 1.0), (2000, 0.5, 1.0), (3000, 40.0, 10.0), (50, 3.0, 100.0)):
        y = (r.random(n) < 0.1).astype(float)
        x = np.stack([np.ones(n), *(scale * (y * gap * (k + 1) + r.normal(size=n)) for k in range(4))], axis=1)
        w = toxicity._logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (y - p) - np.array([1e-3, *[0.1] * 4]) * w
        assert np.abs(slope).max() < 1e-3 * scale * n and ((p > 0.5) == y).mean() > (0.99 if gap > 1 else 0.9)


def test_toxicity_is_its_plain_version(spark):
    r = random.Random(31)
    rows, labels = [], {}
    for i in range(240):
        words, toxic = prose(r, r.randint(5, 60)).split(), r.random() < 0.25
        for _ in range(r.randint(1, 3) * toxic):
            words.insert(r.randrange(len(words)), r.choice(["scoundrel", "Scoundrels", "wretchedé", "fool"]))
        if r.random() < 0.1:
            words.append("fool")
        rows.append((i, " ".join(words)))
        labels[i] = int(toxic)
    rows += [(900, None), (901, ""), (902, "SCOUNDREL! " * 3)]
    docs_, labels_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    want, rate, k = plain_toxicity(rows, labels)
    model = toxicity.fit(docs_, labels_)
    assert model.rate == pytest.approx(rate, rel=1e-6) and model.k == pytest.approx(k, rel=1e-6)
    got = toxicity.op9_toxic(docs_.unionByName(docs_.where("doc_id = 902")), labels_).collect()
    assert len(got) == len(rows) + 1
    # The repeated row is no labelled one, so the model is the same.
    assert all(x["score"] == pytest.approx(want[x["doc_id"]], abs=1e-5) and x["predicted"] == int(want[x["doc_id"]] >= 0.7) for x in got)


def test_toxicity(spark):
    r = random.Random(8)
    bad = ["fool", "scoundrel", "wretch"]
    rows, labels = [], []
    for k in range(600):
        words, toxic = prose(r, 80).split(), k % 6 == 0
        for _ in range(3 * toxic):
            words[r.randrange(80)] = r.choice(bad)
        rows.append((k, " ".join(words), "clash"))
        labels.append((k, int(toxic)))
    rows += [(1000, None, "clash"), (None, "", "clash"), (1001, "fool " * 5000, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.op9_toxic(df, lab).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k in range(600) if got[k]["held_out"]} == set(held) and not got[None]["held_out"]
    assert sum(got[k]["predicted"] == int(k % 6 == 0) for k in held) >= 0.97 * len(held)
    assert got[1000]["predicted"] == 0 and got[None]["predicted"] == 0 and got[1001]["predicted"] == 1
    model = toxicity.fit(df, lab)
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id % 6 = 0 and doc_id < 600").count() <= 3
    spans = toxicity.passages(df.where("doc_id = 1001"), model).first()["passages"]
    assert spans and spans[0]["begin"] == 0
    none = toxicity.op9_toxic(df, lab.limit(0)).collect()
    assert all(x["score"] == 0.5 and x["predicted"] == 0 for x in none)
    assert toxicity.op9_toxic(df.limit(0), lab).count() == 0
