"""Operators on inputs that only the whole job gets right."""

import math
import re

import numpy as np
import pytest
from llm import cases

from pyspark.sql import functions as F

from millrace.llm import decontaminate, gru, kneser_ney, language, rules, substring, suffix


def fragments():
    """Documents with pieces of two long items at their start, in their middle and at their end."""
    items = [(1, [f"a{k}" for k in range(40)]), (2, [f"b{k % 17}" for k in range(60)]), (3, ["c1", "c2", "c3"])]
    docs = []
    for _, words in items:
        for a in range(0, len(words), 9):
            for b in (a + 12, a + 13, a + 21):
                piece = words[a:b]
                for k, text in enumerate((piece + ["x"] * 30, ["x"] * 30 + piece + ["y"] * 30, ["x"] * 30 + piece, piece, words[a:])):
                    docs.append((len(docs), " ".join(text), "en", "s", 1))
    return docs, items


def test_op6_finds_items_cut_at_either_end(spark):
    docs, items = fragments()
    wanted = {}
    for i, text, *_ in docs:
        words, hit, names = re.findall(r"\S+", text), set(), set()
        for item, whole in items:
            width = min(13, len(whole))
            windows = {tuple(whole[k : k + width]) for k in range(len(whole) - width + 1)}
            for p in range(len(words) - width + 1):
                if tuple(words[p : p + width]) in windows:
                    hit |= set(range(p, p + width))
                    names.add(item)
        wanted[i] = (len(words), len(hit), len(names))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.hits(cases.table(spark, docs), benchmark).collect()}
    assert found == wanted


def test_op1_thresholds_are_of_all_trusted(spark):
    docs = [(k, cases.text(k) if k % 3 else cases.text(k).upper() + " 12 " * (k % 11), "en" if k % 3 else "xx", "s", 1) for k in range(240)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(240)], "doc_id long, quality int, toxic int")
    found = kneser_ney.classify(cases.table(spark, docs), labels, trusted=60).collect()
    quantile = lambda x: sorted(x)[math.ceil(0.995 * len(x)) - 1]
    whole = quantile([r["perplexity"] for r in found])
    for lang in ("en", "xx"):
        own = [r["perplexity"] for r in found if r["lang"] == lang]
        (threshold,) = {r["threshold"] for r in found if r["lang"] == lang}
        share = len(own) / (len(own) + kneser_ney.BLEND)
        assert threshold == pytest.approx(quantile(own) ** share * whole ** (1 - share), rel=0.011)


def test_op1_tells_letters_beyond_ascii():
    words = ["мама", "пепе", "ужин", "日本", "中国", "سلام", "كتاب"]
    seen = set()
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        context, symbol, begin = kneser_ney.grams(raw, np.array([0, len(raw)]))
        assert begin.tolist() == [0, len(w) + 1] and symbol.tolist() == [*(ord(c) + 1 for c in w), 0]
        seen.add(tuple(context.tolist()))
    assert len(seen) == len(words)
    bad = b"ab\xffc\x82" + "é".encode()
    _, _, begin = kneser_ney.grams(np.frombuffer(bad, np.uint8), np.array([0, 5, 7]))
    assert begin.tolist() == [0, 6, 8]


def shuffled(spark, job) -> list[tuple[int, int]]:
    """Rows and bytes that each stage of a job writes for others to fetch."""
    sc, jvm, gateway = spark.sparkContext._jsc.sc(), spark._jvm, spark.sparkContext._gateway

    def stages_so_far() -> dict[int, tuple[int, int]]:
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        stages = [stages.apply(i) for i in range(stages.size())]
        return {x.stageId(): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in stages}

    before = stages_so_far()
    job()
    return [x for k, x in stages_so_far().items() if k not in before]


def test_op1_sends_no_row_for_a_document_and_gram(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BROADCAST_ROWS", 0)
    model = kneser_ney.Model(spark.createDataFrame([(cases.text(k),) for k in range(3)], "text string"))
    few, many = (cases.table(spark, [(k, cases.text(1, 80), "en", "s", 1) for k in range(n)]) for n in (40, 240))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as of tables too large for it
    try:
        rows = [sum(n for n, _ in shuffled(spark, lambda: kneser_ney.log_probabilities(x, [model]))) for x in (few, many)]
    finally:
        spark.conf.set(threshold, before)
    assert rows[1] - rows[0] < 10 * 200  # each of the copies has more than a hundred distinct 4-grams


def test_op1_shuffles_part_of_the_texts_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(97, 101, 20_000))) for _ in range(64)]
    docs = cases.table(spark, [(k, x, "en", "s", 1) for k, x in enumerate([*texts, None, ""])])
    model = kneser_ney.Model(spark.createDataFrame([(x,) for x in texts[:2]], "text string"))
    whole, dealt = [], []
    at_once = max(n for _, n in shuffled(spark, lambda: whole.extend(kneser_ney.log_probabilities(docs, [model]).collect())))
    monkeypatch.setattr(kneser_ney, "chunk_count", lambda docs: 10 * spark.sparkContext.defaultParallelism)
    in_rounds = max(n for _, n in shuffled(spark, lambda: dealt.extend(kneser_ney.log_probabilities(docs, [model]).collect())))
    assert in_rounds < at_once / 2
    by_id = lambda rows: sorted((r["doc_id"], r["has_text"], r["n_symbols"], r["log_0"]) for r in rows)
    assert len(dealt) == 66 and by_id(dealt) == by_id(whole)


def test_op1_finds_grams_whose_keys_agree(monkeypatch):
    monkeypatch.setattr(kneser_ney, "_keys", lambda context, symbol: (context // 40).astype(np.uint64) << np.uint64(57))
    rng = np.random.default_rng(5)
    texts = [(np.repeat(rng.integers(0, 80, 30) * 40, 3), np.tile(np.arange(3, dtype=np.int32), 30)) for _ in range(20)]
    counts, wanted = kneser_ney.Counts(), {}
    for context, symbol in texts:
        counts.add(context, symbol)
        for x in zip(context.tolist(), symbol.tolist()):
            wanted[x] = wanted.get(x, 0) + 1
    counts.merge()
    found = {}
    for x, y, n in zip(counts.grams.context.tolist(), counts.grams.symbol.tolist(), counts.n.tolist()):
        found[x, y] = found.get((x, y), 0) + n
    assert found == wanted
    at = counts.grams.find(*texts[0])
    assert (counts.grams.context[at] == texts[0][0]).all() and (counts.grams.symbol[at] == texts[0][1]).all()
    assert (counts.grams.find(np.array([81 * 40, 40]), np.array([0, 3], np.int32)) == len(counts.grams)).all()


def test_op2_fences_follow_the_group(spark):
    def lined(i, short):
        return "\n".join(" ".join(f"w{i:03d}{k * 10 + j:02d}" for j in range(10)) + "\n" + x for k, x in enumerate(short))

    rare, usual = {1, 2}, set(range(300, 330))  # of 200 documents each: 4 and 5 of 12 lines repeated
    docs = [(i, lined(i, "xxxxxf" if i in rare else "xxxxxx" if i in usual else "abcdef"), "en" if i < 300 else "de", "s", 1) for i in [*range(200), *range(300, 500)]]
    found = {r["doc_id"]: r["kept"] for r in rules.judge(cases.table(spark, docs)).collect()}
    assert {i for i, kept in found.items() if not kept} == rare


def thue_morse(n):
    """Two words of n letters that every polynomial hash modulo 2**64 with an odd base takes for one, n from 1024."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_one_polynomial_hash_are_told_apart(spark, n):
    a, b = thue_morse(n)
    rest = [f"w{k}" for k in range(49)]
    docs = cases.table(spark, [(1, " ".join([a, *rest]), "en", "s", 1), (2, " ".join([b, *rest]), "en", "s", 1), (3, " ".join([b, *rest]), "en", "s", 1), (4, f"c d {a} x c d {b}", "en", "s", 1)])
    assert {r["doc_id"]: r["n_removed"] for r in substring.repeated_passages(docs).collect()} == {1: 0, 2: 0, 3: 50, 4: 0}
    assert {r["doc_id"]: r["n_repeat_words"] for r in rules.judge(docs).collect()}[4] == 0
    scored = {r["doc_id"]: r for r in gru.score_documents(docs, F.col("doc_id") == 2).collect()}
    assert scored[2]["n_known"] == 51  # document 3 has its words
    scored = {r["doc_id"]: r for r in gru.score_documents(docs, F.col("doc_id") > 1).collect()}
    assert scored[1]["n_known"] == 51 and scored[2]["n_known"] == 50 and scored[1]["train_tokens"] == 51
    # suffix dedup: snippets of the two are not one
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    first, wanted = {}, {}
    for i in sorted(texts):
        s = texts[i]
        gone = [False] * len(s)
        for p in range(len(s) - 49):
            if first.setdefault(s[p : p + 50], i) < i:
                gone[p : p + 50] = [True] * 50
        wanted[i] = sum(gone)
    assert {r["doc_id"]: r["n_removed"] for r in suffix.repeated_bytes(docs).collect()} == wanted


def test_op10_takes_nothing_that_its_source_lacks():
    """Windows whose keys agree are still compared word for word."""
    own = [f"w{k}" for k in range(60)]
    left = substring._same_words(" ".join(own).encode(), *zip(*[(m.start(), m.end()) for m in re.finditer(r"\S+", " ".join(own))]), 0, 11, [b" " + " ".join(own[5:60]).encode() + b" "], 50)
    assert left == [(k, 1) for k in range(5, 11)]


def test_op4_learns_every_language(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(200):
        syllables = [letters[k % 26] + letters[(k // 26 + j * 3) % 26] + letters[(k * 7 + j * 5) % 26] for j in range(4)]
        rows += [(1000 * k + j, " ".join((syllables[(i * (j + 1)) % 4] + syllables[(i + j) % 4]) for i in range(30)), f"l{k:03d}", "s", 1) for j in range(2)]
    docs = cases.table(spark, rows)
    model = language.train(docs)
    found = language.predict(docs, model, ["doc_id", "lang"]).collect()
    assert len(model.langs) == 200 and np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    # by hand, of some documents, over all 200 at once
    names, matrix, prior = zip(*model.blocks())
    names, matrix, prior = [x for n in names for x in n], np.concatenate(matrix).astype(float), np.concatenate(prior)
    of = {r["doc_id"]: r for r in found}
    for i, text, *_ in rows[::37]:
        raw = text.encode()
        grams, _, _ = language.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        total = prior + sum(matrix[:, g].sum(axis=1) for g in grams)
        p = np.exp(total - total.max())
        assert of[i]["lang_pred"] == names[int(total.argmax())] and of[i]["score"] == pytest.approx(p.max() / p.sum(), rel=1e-5)


def test_op6_judges_every_row(spark):
    item = " ".join(f"q{k}" for k in range(13))
    docs = cases.table(spark, [(1, item + " and", "en", "s", 1)] * 3 + [(1, "other", "en", "s", 1), (None, item, "en", "s", 1), (None, item, "en", "s", 1)])
    found = decontaminate.hits(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in found) == [(0, 13, 13)] * 2 + [(1, 1, 0)] + [(1, 14, 13)] * 3


def test_op2_fences_of_small_groups_blend(spark):
    """Ten marks a document: how far a group's own quantiles count grows row by row, without a size that flips it."""
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "a", 1) for i in range(4000)]
    ends = []
    for n in (24, 25, 49, 50, 51):
        marked = [(1000 + i, " ".join(f"v{i}x{j}" for j in range(60)) + " #" * 10, "en", "b", 1) for i in range(n)]
        limits = rules.fences(rules.measures(cases.table(spark, plain + marked)).where("n_words > 0"))
        ends.append({r["source"]: r["high_symbol_share"] for r in limits.collect()}["b"])
    own = 10 / (sum(len(f"v{0}x{j}") for j in range(60)) + 10)
    steps = [b - a for a, b in zip(ends, ends[1:])]
    assert all(0 < s < 0.02 * own for s in (steps[0], steps[2], steps[3])) and 0.2 * own < ends[0] < ends[-1] < 0.9 * own


def test_op1_is_fitted_on_every_trusted_document(spark, monkeypatch):
    import inspect

    assert inspect.signature(kneser_ney.classify).parameters["trusted"].default is None  # no cap unless the caller sets one
    fitted = []

    class Counted(kneser_ney.Model):
        def __init__(self, texts):
            fitted.append(texts.count())
            super().__init__(texts)

    monkeypatch.setattr(kneser_ney, "Model", Counted)
    docs = [(k, cases.text(k), "en", "s", 1) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(cases.table(spark, docs), labels).count() == 60 and sum(fitted) == 45
