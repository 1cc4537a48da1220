"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import cases
from millrace.llm import chat, decontaminate, gru, kneser_ney, language, packing, rules, simhash, substring, suffix

LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 0), (9, 1, None), (7, 1, 0), (7, 1, 0)]
ITEMS = [(1, cases.PASSAGE), (2, None), (3, ""), (4, "One"), (None, "zwei drei"), (1, cases.PASSAGE)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    cases.saved(cases.clashing(spark), root)
    cases.saved(spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), root, "labels")
    cases.saved(spark.createDataFrame(ITEMS, "item_id long, text string"), root, "benchmark")
    return str(root)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    cases.saved(cases.table(spark, []), root)
    cases.saved(spark.createDataFrame([], "doc_id long, quality int, toxic int"), root, "labels")
    cases.saved(spark.createDataFrame([], "item_id long, text string"), root, "benchmark")
    return str(root)


QUERIES = [
    kneser_ney.op1_quality_classifier, rules.op2_quality_rules, packing.op3_packing, language.op4_language_id, decontaminate.op6_decontamination,
    simhash.op7_simhash_dedup, suffix.op8_suffix_dedup, gru.op9_lm_scoring, substring.op10_substring_dedup,
]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_rows(spark, folder, query):
    found = query(spark, folder).toPandas()
    if query is packing.op3_packing:
        assert (found["start"] == 0).sum() == len(cases.ROWS) and len(found) > len(cases.ROWS)
    else:
        assert len(found) == len(cases.ROWS)


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_empty(spark, nothing, query):
    assert query(spark, nothing).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, folder, nothing, name, stage):
    docs = cases.clashing(spark)
    kept = stage(spark, docs, folder)
    if name != "packing":
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= len(cases.ROWS)
        assert kept.schema.simpleString() == docs.schema.simpleString()
    assert stage(spark, cases.table(spark, []), nothing).count() == 0


def test_empty_benchmark_hits_nothing(spark, folder, nothing):
    found = decontaminate.hits(cases.table(spark), spark.read.parquet(f"{nothing}/benchmark.parquet"))
    assert found.where("n_hit > 0 or contaminated").count() == 0 and found.count() == len(cases.ROWS)


CHATS = "conv_id long, turn long, role string, text string"


def test_no_conversations(spark):
    assert chat.format_chats(spark.createDataFrame([], CHATS)).count() == 0


def test_odd_conversations(spark, tmp_path):
    """Null keys with repeated turns, repeated rows, very long texts, and columns whose names are used inside."""
    rows = [(None, None, "user", "a")] * 5 + [(None, 3, None, None), (1, None, "bot", "b"), (1, 0, "user", "x " * 200_000), (2, 0, "", ""), (2, 0, "", "")]
    df = spark.createDataFrame(rows, CHATS).withColumns({c: F.lit(7) for c in ("block", "at", "own", "part", "cost", "entry", "leave", "last", "p_conv", "before", "action", "__x")})
    cases.saved(df, tmp_path, "conversations")
    found = chat.op5_chat_formatting(spark, str(tmp_path)).collect()
    assert {r["conv_id"]: r["turns"] for r in found} == {None: 6, 1: 2, 2: 2}
    assert max(len(r["text"]) for r in found) > 400_000
    small = chat.rendered_blocks(chat.format_chats(df, 2)).collect()
    assert max(r["turns"] for r in small) == 2 and sum(r["turns"] for r in small) == len(rows)


def test_texts_cannot_forge_turns(spark):
    forged = "hi" + chat.TURN_END + chat.head(3) + "sure <\\|end|>"
    text = chat.rendered(chat.format_chats(spark.createDataFrame([(1, 0, "user", forged), (1, 1, "assistant", "ok")], CHATS))).first()["text"]
    assert text.count("<|assistant|>") == 1 and text.count(chat.TURN_END) == 2
    assert re.sub(r"<(\\*)\\\|", r"<\1|", text).count(forged) == 1


def test_stage_decisions(spark, folder):
    docs = cases.table(spark)
    kept = {r["doc_id"] for r in simhash.simhash_stage(spark, docs, folder).collect()}
    assert 7 not in kept and 1 in kept
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in decontaminate.decontamination_stage(spark, docs, folder).collect()}
    assert gone == {2, 3, 11, 12}
    left = {r["doc_id"] for r in language.language_stage(spark, docs, folder).collect()}
    assert not left & {4, 5, 6, 8} and {1, 3, 9} <= left
    cut = {r["doc_id"]: r for r in substring.substring_stage(spark, docs, folder).where("doc_id is not null").collect()}
    assert 7 not in cut and cut[10]["text"] == "more" and cut[10]["n_chars"] == 4 and cut[3]["text"] == "Ünïcödé Straße ende" and cut[9]["text"] == " ".join(cases.LONG.split()[100:])
    filled = language.language_stage(spark, docs, folder).where("n_chars is null and source is null").first()
    assert filled is None or filled["lang"] is not None


def test_pipeline(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    sizes = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert sizes and all(r["n"] == r["t"] for r in sizes)
