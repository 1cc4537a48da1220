"""Models against what they must satisfy: probabilities that sum to one, counts by hand, held-out gains, sketch errors."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm import cases
from pyspark.sql import functions as F

from millrace.llm import chat, gru, kneser_ney, language, sketch

DATA = "/root/testdata/sf0.01"


def test_quantiles_are_close(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), F.pow(F.lit(1.005), F.col("id")).alias("v"), F.lit(0.0).alias("z"))
    parts = [sketch.sketch(df.where(c), ["k"], ["v", "z"]) for c in ("id < 700", "id >= 700")]
    merged = sketch.merge(parts[0].union(parts[1]), ["k"])
    found = {(r["k"], r["metric"]): r for r in sketch.quantiles(merged, ["k"], {"q": 0.5}).collect()}
    for k in (0, 1):
        exact = sorted(1.005**i for i in range(2000) if i % 2 == k)[499]
        assert found[k, "v"]["q"] == pytest.approx(exact, rel=0.011) and found[k, "v"]["total"] == 1000 and found[k, "z"]["q"] == 0.0


def kneser_ney_by_hand(texts):
    """The interpolated modified Kneser-Ney probability of (context, symbol), from the definition, by dictionaries."""
    grams = [Counter() for _ in range(5)]
    for t in texts:
        padded = ["^"] * 3 + list(t) + ["$"]
        for i in range(3, len(padded)):
            grams[4][tuple(padded[i - 3 : i + 1])] += 1
    for k in (3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discounts, totals, freed = {}, {}, {}
    for k in range(1, 5):
        n = [sum(c == j for c in grams[k].values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        discounts[k] = [0.0, *(min(j, max(0, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else j / 2 for j in (1, 2, 3))]
        totals[k], freed[k] = Counter(), Counter()
        for g, c in grams[k].items():
            totals[k][g[:-1]] += c
            freed[k][g[:-1]] += discounts[k][min(c, 3)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(grams[1]) + 1)
        context = gram[:-1]
        if not totals[k][context]:
            return p(gram[1:])
        c = grams[k][gram]
        return (c - discounts[k][min(c, 3)]) / totals[k][context] + freed[k][context] / totals[k][context] * p(gram[1:])

    return p, sorted({g[0] for g in grams[1]})


def test_kneser_ney(spark):
    texts = [cases.text(k, 30) + ". " + cases.text(k + 3, 20) for k in range(9)] + ["мама мыла раму", "日本語の日本"]
    p, symbols = kneser_ney_by_hand(texts)
    for context in (("^", "^", "^"), ("a", "l", "p"), ("м", "а", "м"), ("z", "z", "z")):
        assert sum(p((*context, x)) for x in symbols) + p((*context, "unseen")) == pytest.approx(1)
    docs = [*texts[:3], "alpha qqq Ω мама", "", None, "日本中", texts[0] * 40]
    rows = spark.createDataFrame([(k, t, "en") for k, t in enumerate(docs)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in kneser_ney.log_probabilities(rows, [kneser_ney.Model(spark.createDataFrame([(t,) for t in texts], "text string"))]).collect()}
    for k, t in enumerate(docs):
        padded = ["^"] * 3 + list(t or "") + ["$"]
        total = sum(math.log(p(tuple(padded[i - 3 : i + 1]))) for i in range(3, len(padded)))
        assert found[k]["n_symbols"] == len(padded) - 3 and found[k]["log_0"] == pytest.approx(total, rel=1e-9)


def test_kneser_ney_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, cases.text(k), "en") for k in range(6)], "doc_id long, text string, lang string")
    model = kneser_ney.Model(docs.where("doc_id < 4"))
    wanted = {r["doc_id"]: r["log_0"] for r in kneser_ney.log_probabilities(docs, [model]).collect()}
    monkeypatch.setattr(kneser_ney, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(kneser_ney, "HELD_GRAMS", 10)
    assert {r["doc_id"]: r["log_0"] for r in kneser_ney.log_probabilities(docs, [model]).collect()} == pytest.approx(wanted)


def test_op1_tells_quality(spark):
    found = kneser_ney.op1_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert found[found["quality"] == 1]["kept"].mean() > 0.98 and found[found["quality"] == 0]["kept"].mean() < 0.4


def network():
    rng = np.random.default_rng(0)
    v = type("V", (), {})()
    v.entry_mass = rng.random((gru.CLASSES + 1, gru.ENTRIES)) + 0.1
    v.entry_mass[gru.CLASSES, 1:] = 0
    v.class_mass = v.entry_mass.sum(axis=1)
    net = gru.Network.start(v)
    net.C, net.U = net.C * 20, net.U * 20
    return net


def test_network_sums_to_one():
    net = network()
    h = np.tanh(np.random.default_rng(1).standard_normal((1, gru.HIDDEN))).astype(np.float32)
    every = np.array([c * gru.ENTRIES + e for c in range(gru.CLASSES) for e in range(gru.ENTRIES)] + [gru.CLASSES * gru.ENTRIES])
    assert np.exp(net.log_softmax(np.repeat(h, len(every), axis=0), every).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_scores_carry_the_state_through_each_text():
    net, rng, end = network(), np.random.default_rng(2), gru.CLASSES * gru.ENTRIES
    texts = [np.append(rng.integers(0, end, int(n)), end) for n in (0, 1, 5, 300, 40, 1200)]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = gru.score(net, np.concatenate(texts).astype(np.int32), begin, window=7)
    for t, s in zip(texts, found):
        h, last, total = np.zeros((1, gru.HIDDEN), np.float32), end, 0.0
        for code in t:
            h = net.step(np.array([last]), h)[0]
            total += float(net.log_softmax(h, np.array([code]))[0])
            last = code
        assert s == pytest.approx(total, rel=1e-3)


def test_gradients():
    """The states' gradient of the output loss against finite differences."""
    net, rng = network(), np.random.default_rng(3)
    h = rng.standard_normal((6, gru.HIDDEN)).astype(np.float32) * 0.3
    target = np.array([0, 70, 130, gru.CLASSES * gru.ENTRIES, 2000, 63])
    loss = lambda x: -float(net.log_softmax(x.astype(np.float32), target).astype(float).sum())
    numeric = np.zeros((6, 3))
    for i in range(6):
        for k in range(3):
            a, b = h.copy(), h.copy()
            a[i, k] += 1e-2
            b[i, k] -= 1e-2
            numeric[i, k] = (loss(a) - loss(b)) / 2e-2
    assert np.allclose(gru.Trainer(net).outputs(h, target)[:, :3], numeric, atol=2e-2)


def test_op9(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    found = gru.op9_lm_scoring(spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_chat_costs(spark):
    """Blocks of any size give the least cost, and the rendering is legal."""
    rng = np.random.default_rng(5)
    roles = ["user", "assistant", "system", "Human", None, "tool"]
    rows = [(int(k), t, roles[rng.integers(0, 6)], f"t{t}") for k in range(30) for t in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = ({r["conv_id"]: r for r in chat.rendered(chat.format_chats(df, b)).collect()} for b in (1000, 2))
    for k in whole:
        given = [{"user": "u", "Human": "u", "assistant": "a", "system": "s"}.get(r) for c, _, r, _ in rows if c == k]

        def least(i, last, inserted=0, given=given):
            """By trying everything: turns follow as START s? (u a)+; inserting costs 3, relabelling 2 (1 of no role), merging 1 more."""
            follows = {None: "su", "s": "u", "u": "a", "a": "u"}[last]
            best = 0 if i == len(given) and last == "a" else 10**6
            if inserted < 3:
                best = min([best, *(3 + least(i, x, inserted + 1) for x in follows)])
            if i < len(given):
                as_ = lambda x: 0 if given[i] == x else 2 if given[i] else 1
                best = min([best, *(as_(x) + least(i + 1, x) for x in follows)])
                if last:
                    best = min(best, 1 + as_(last) + least(i + 1, last))
            return best

        assert whole[k]["cost"] == cut[k]["cost"] == least(0, None)
        for r in (whole[k], cut[k]):
            assert re.fullmatch(r"(<\|system\|>)?(<\|user\|><\|assistant\|>)+", "".join(re.findall(r"<\|(?:system|user|assistant)\|>", r["text"])))
            assert r["text"].endswith(chat.TURN_END) and all(t in r["text"] for c, _, _, t in rows if c == k)


def test_chat_keeps_legal_ones(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None), (2, 0, "User", "q"), (2, None, "bot", "a")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.rendered(chat.format_chats(df)).collect()}
    assert found[1]["cost"] == found[2]["cost"] == 0
    assert found[1]["text"] == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\n<|end|>\n"


def test_op9_does_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(gru, "SHARD_TOKENS", 20_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 400")
    found = [{r["doc_id"]: r["score"] for r in gru.score_documents(docs.repartition(n)).collect()} for n in (1, 4, 32)]
    for other in found[1:]:
        assert all(other[i] == pytest.approx(s, rel=1e-4) for i, s in found[0].items())


def test_op9_takes_every_position():
    """The network's own step: one document of four words over and over is all but certain in the end."""
    v = type("V", (), {})()
    v.entry_mass = np.full((gru.CLASSES + 1, gru.ENTRIES), 1.0)
    v.entry_mass[gru.CLASSES, 1:] = 0
    v.class_mass = v.entry_mass.sum(axis=1)
    trainer = gru.Trainer(gru.Network.start(v))
    code = np.tile(np.array([5, 300, 77, 1200], np.int32), 12_000)
    trainer.train(code, np.array([0, len(code)]))
    assert gru.score(trainer.net, code[:400], np.array([0, 400])).sum() / 400 > -0.5


def test_op9_averages_in_levels(spark, monkeypatch):
    monkeypatch.setattr(gru, "SHARD_TOKENS", 8_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 200")
    found = []
    for fan_in in (256, 2):
        monkeypatch.setattr(gru, "FAN_IN", fan_in)
        found.append({r["doc_id"]: r["score"] for r in gru.score_documents(docs).collect()})
    assert all(found[1][i] == pytest.approx(s, rel=1e-3) for i, s in found[0].items())


def test_op4_counts_by_hand(spark):
    """Every language's count of every bucket, from letters taken one by one."""

    def scrambled(x):
        for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            x = (x ^ (x >> shift)) * times & (2**64 - 1)
        return x

    def bucket(gram):
        key = len(gram)
        for c in gram:
            key = (key * 0x110003 + c) & (2**64 - 1)
        return scrambled(key) & (language.BUCKETS - 1)

    rows = [*cases.ROWS, *[(r["doc_id"], r["text"], r["lang"], "s", 1) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40").collect()]]
    known, wanted = {}, Counter()
    for _, text, lang, *_ in rows:
        if text is None or lang is None:
            continue
        wanted[lang, -1] += 1
        letters = [32, *((ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32 for c in text), 32]
        grams = [(c,) for c in letters if c != 32]
        grams += [g for g in zip(letters, letters[1:]) if g != (32, 32)]
        grams += [g for g in zip(letters, letters[1:], letters[2:]) if g[1] != 32]
        for g in grams:
            if g not in known:
                known[g] = bucket(g)
            wanted[lang, known[g]] += 1
    found = {(r["lang"], r["bucket"]): r["n"] for r in language.train(cases.table(spark, rows)).counts.collect()}
    assert found == dict(wanted)
