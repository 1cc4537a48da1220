"""Quality rules: adaptive thresholds from mergeable quantile sketches per language and source.

Every document's measures are taken in numpy, the sketches are bucket counts per (language, source), and a
document is kept if each measure lies within the fences of its own group: the quartiles moved out by three times
their distance, or the group's outer quantiles where these lie further out. A group of few documents takes the fences of its language, then of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import sketch
from millrace.llm.common import chunks, lean, read_table, text_column, word_numbers, words, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MARKS = np.zeros(256, bool)
MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[0x41:0x5B] = True
MEASURES = ("mean_word", "symbol_share", "mark_share", "capital_share", "dup_line_share", "repeat_share")
SPREAD = 3.0
#: The group's quantiles of this rank, and of 1 less it, are within its fences: the slack where quartiles coincide.
OUTER = 0.98
RANKS = {"q1": 0.25, "q3": 0.75, "lo": 1 - OUTER, "hi": OUTER}
#: Groups of fewer documents share their quantiles with their language in proportion, languages with the corpus.
FULL_GROUP = 100
BROADCAST_ROWS = 100_000


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs of numbers, counting from 0."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words in a window of ``width`` words that the text has twice or more, compared exactly."""
    n = len(starts)
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    last = n - width + 1
    number = word_numbers(data, starts, ends)
    window = number[:last]
    for k in range(1, width):
        window = _numbered(window, number[k : k + last])
    at = np.flatnonzero(text[:last] == text[width - 1 :])
    keys = window[at] * len(first) + text[at]  # below the square of the chunk's bytes
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(width):
        hit[at[twice] + k] = True
    return _sums(hit, first)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = words(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    length = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    raw = data.tobytes()
    lines, dups = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        found = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[i], dups[i] = len(found), len(found) - len(set(found))
    return {
        "n_words": np.diff(first),
        "word_chars": np.diff(length[first]),
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_dup_lines": dups,
        "n_repeat_words": repeated_words(data, starts, ends, first),
        "n_lines": lines,
        "n_marks": _sums(MARKS[data], offsets),
        "n_capitals": _sums(CAPITALS[data], offsets),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measure(data, offsets) for _, _, data, offsets in chunks(text_column(batch, "text"))]
        cols = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)) for c in _COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], ["doc_id", "lang", "source", *_COUNTS])


def measures(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(_measure), schema)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return found.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "mark_share": share("n_marks", "word_chars"),
            "capital_share": share("n_capitals", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def fences(measured: DataFrame) -> DataFrame:
    """(lang, source, low_..., high_... of each measure) for every group of the corpus."""
    groups = sketch.sketch(measured, ["lang", "source"], list(MEASURES))
    langs = sketch.merge(groups, ["lang"])
    own = sketch.quantiles(groups, ["lang", "source"], RANKS)
    by_lang = sketch.quantiles(langs, ["lang"], RANKS).toDF("l_lang", "l_metric", "l_total", *[f"l_{q}" for q in RANKS])
    whole = sketch.quantiles(sketch.merge(langs, []), [], RANKS).toDF("w_metric", "w_total", *[f"w_{q}" for q in RANKS])
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(whole, F.col("metric") == F.col("w_metric"))
    # the smaller a group, the more it follows its language, and that the corpus: each row moves its fences a little
    share = lambda n: F.least(F.col(n) / FULL_GROUP, F.lit(1.0))
    mean = lambda w, a, b: w * a + (1 - w) * b
    pick = lambda q: mean(share("total"), F.col(q), mean(share("l_total"), F.col(f"l_{q}"), F.col(f"w_{q}")))
    chosen = joined.select("lang", "source", "metric", *[pick(q).alias(q) for q in RANKS])
    step = SPREAD * (F.col("q3") - F.col("q1"))
    # widened by the sketch's error, so that values equal to a quantile are within
    low, high = F.least(F.col("q1") - step, F.col("lo")) / sketch.GAMMA, F.greatest(F.col("q3") + step, F.col("hi")) * sketch.GAMMA
    ends = chosen.select("lang", "source", "metric", low.alias("low"), high.alias("high"))
    return ends.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"{x}_{m}") for m in MEASURES for x in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed and kept.

    Null and empty texts have no words: they fail the base rule and enter no sketch. Null languages and sources
    are groups like any other. Repeated rows are judged each. An empty table gives no rows; other columns are ignored.
    """
    measured = written(measures(docs), "rules-measures")
    limits = written(fences(measured.where("n_words > 0")).withColumnRenamed("lang", "f_lang").withColumnRenamed("source", "f_source"), "rules-fences")  # a row per group
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    within = F.lit(True)
    for m in MEASURES:
        within &= F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & within)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]"


def _sql_quantiles(sketch_table: str, keys: str) -> str:
    """Quantiles of a table (keys..., metric, bucket, n), as ``sketch.quantiles`` takes them."""
    by = f"{keys}, metric" if keys else "metric"
    found = ", ".join(f"min(bucket) filter (where up_to >= '{r!r}'::double * total) {name}" for name, r in RANKS.items())
    values = ", ".join(f"case when {q} > {sketch.ZERO} then pow('{sketch.GAMMA}'::double, {q}) * '{2 / (1 + sketch.GAMMA)!r}'::double else 0 end {q}" for q in RANKS)
    return f"""select {by}, total, {values} from (
    select {by}, max(total) total, {found} from (
      select *, sum(n) over (partition by {by} order by bucket) up_to, sum(n) over (partition by {by}) total from {sketch_table}) group by {by})"""


OP2_SQL = f"""
with d as (select row_number() over () r, doc_id, lang, source, coalesce(text, '') t from documents
), w as (select *, regexp_extract_all(t, '{_WORD}+') w from d
), g as (select r, i, array_to_string(list_slice(w, i, i + 2), ' ') x from (select r, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)
), twice as (select r, i from g qualify count(*) over (partition by r, x) > 1
), repeated as (select r, count(distinct q) n_repeat_words from (select r, unnest([i, i + 1, i + 2]) q from twice) group by r
), lines as (
  select r, count(*) n_lines, count(*) - count(distinct x) n_dup_lines
  from (select r, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '{_WORD}') group by r
), c as (
  select r, doc_id, lang, source, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) n_repeat_words, n_lines,
    len(regexp_extract_all(t, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]')) n_marks, len(regexp_extract_all(t, '[A-Z]')) n_capitals
  from w left join repeated using (r) left join lines using (r)
), m as (
  select r, lang, source, unnest(['mean_word', 'symbol_share', 'mark_share', 'capital_share', 'dup_line_share', 'repeat_share']) metric,
    unnest([word_chars / n_words, n_symbols / word_chars, n_marks / word_chars, n_capitals / word_chars, n_dup_lines / n_lines, n_repeat_words / n_words]) v
  from c where n_words > 0
), s as (
  select lang, source, metric, case when v > 0 then cast(ceil(ln(v) / '{math.log(sketch.GAMMA)!r}'::double) as int) else {sketch.ZERO} end bucket, count(*) n
  from m group by all
), by_lang as (select lang, metric, bucket, sum(n) n from s group by all
), by_none as (select metric, bucket, sum(n) n from s group by all
), own as ({_sql_quantiles("s", "lang, source")}
), of_lang as ({_sql_quantiles("by_lang", "lang")}
), of_all as ({_sql_quantiles("by_none", "")}
), chosen as (
  select own.lang, own.source, own.metric,
    least(own.total / {FULL_GROUP}, 1) own_share, least(l.total / {FULL_GROUP}, 1) lang_share,
    {", ".join(f"own_share * own.{q} + (1 - own_share) * (lang_share * l.{q} + (1 - lang_share) * a.{q}) {q}" for q in RANKS)}
  from own join of_lang l on own.lang is not distinct from l.lang and own.metric = l.metric join of_all a on own.metric = a.metric
), limits as (
  select lang, source, metric, least(q1 - {SPREAD} * (q3 - q1), lo) / '{sketch.GAMMA}'::double low, greatest(q3 + {SPREAD} * (q3 - q1), hi) * '{sketch.GAMMA}'::double high from chosen
), outside as (
  select distinct r from m join limits f on m.lang is not distinct from f.lang and m.source is not distinct from f.source and m.metric = f.metric
  where v < low or v > high
), judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from outside) kept from judged
"""
