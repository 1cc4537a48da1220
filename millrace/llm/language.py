"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are sums over all labelled documents, gathered per task as sparse (language, bucket) counts and
added up in one aggregation. Every language is learned. The log-probability matrix is broadcast in blocks of
``BLOCK`` languages, whose size does not depend on the corpus; each batch is scored in numpy by gathering matrix cells
and differencing a running sum, and the blocks hand on each text's best language and log-sum of exponentials.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import chunks, crc_mod, discard, lean, mix, read_table, text_column, written

BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of one broadcast: 64 * 2**17 * 4 bytes = 32 MB. So many blocks are scored side by side in one stage.
BLOCK, BLOCKS_AT_ONCE = 64, 4
UNDETERMINED = "und"


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or 32 where it is none."""
    out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of letters and gaps, where each text's begin (texts + 1), and whether each text has a letter."""
    lead = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    if len(points) != before[-1]:  # ill-formed bytes: text by text
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        points, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    else:
        at = before[offsets]
    n, texts = len(points), len(offsets) - 1
    folded = np.full(n + texts + 2, 32, dtype=np.uint64)  # a gap between texts
    where = np.arange(n) + np.repeat(np.arange(texts) + 1, np.diff(at))
    folded[where] = _folded()[points]
    letter = folded != 32
    first = at + np.arange(texts + 1)  # the gap before each text
    seen = np.concatenate([[0], np.cumsum(letter)])
    has = seen[first[1:]] > seen[first[:-1]]
    solid = letter[1:] | letter[:-1]  # runs of gaps give no features
    grams, keep_at = [], []
    for order in ORDERS:
        key = np.full(len(folded) - order + 1, order, dtype=np.uint64)
        for k in range(order):
            key = key * np.uint64(0x110003) + folded[k : k + len(key)]
        if order == 1:
            keep = letter.copy()
        else:
            keep = solid[: len(key)] if order == 2 else letter[1 : 1 + len(key)]
        index = np.flatnonzero(keep)
        grams.append((mix(key[index]) & np.uint64(BUCKETS - 1)).astype(np.int32))
        keep_at.append(index)
    # each order is kept apart; texts are the spans between gaps
    bounds = [np.searchsorted(k, first) for k in keep_at]
    return grams, bounds, has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse sums per (language, bucket); bucket -1 counts the texts of a language."""
    codes: dict[str, int] = {}
    held, size = [], 0

    def done() -> pa.RecordBatch:
        keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        keys, n = keys[order][first], np.add.reduceat(n[order], first)
        names = pa.array(list(codes)).take(pa.array(keys // (BUCKETS + 1)))
        return pa.RecordBatch.from_arrays([names, pa.array((keys % (BUCKETS + 1) - 1).astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    for batch in batches:
        lang = batch.column(1).to_pylist()
        for lo, hi, data, offsets in chunks(text_column(batch, "text")):
            grams, bounds, _ = features(data, offsets)
            of = np.array([codes.setdefault(x, len(codes)) for x in lang[lo:hi]], dtype=np.int64) * (BUCKETS + 1)
            each = [of, *(np.repeat(of, np.diff(b)) + g[b[0] : b[-1]] + 1 for g, b in zip(grams, bounds))]
            held.append(np.unique(np.concatenate(each), return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield done()
                held, size = [], 0
    if held:
        yield done()


@dataclass
class Model:
    """Languages in order, the logs of their documents, and their counts as a table (lang, bucket, n)."""

    langs: list[str]
    prior: np.ndarray
    counts: DataFrame

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Names, log-probabilities (language x bucket) and log priors of BLOCK languages at a time."""
        for lo in range(0, len(self.langs), BLOCK):
            names = self.langs[lo : lo + BLOCK]
            found = self.counts.where((F.col("bucket") >= 0) & F.col("lang").isin(names)).toArrow()
            at = np.searchsorted(np.array(names, dtype=object), found["lang"].to_numpy().astype(object)) if len(found) else np.zeros(0, np.int64)
            counts = np.zeros((len(names), BUCKETS))
            counts[at, found["bucket"].to_numpy()] = found["n"].to_numpy()
            total = counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS
            yield names, (np.log(counts + SMOOTHING) - np.log(total)).astype(np.float32), self.prior[lo : lo + BLOCK]


def train(docs: DataFrame) -> Model:
    """From the rows with text and language. A row per language reaches the driver, and BLOCK languages' counts at a time."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(lean(_count), "lang string, bucket int, n long")
    counts = written(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    texts = sorted((r["lang"], r["n"]) for r in counts.where("bucket = -1").collect())
    return Model([x for x, _ in texts], np.log(np.array([n for _, n in texts], dtype=float)), counts)


def _score(sent):
    """Adds a block's languages to each text's best one, its log-probability, and the log-sum over all so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = sent.value
        for batch in batches:
            if not len(batch):
                continue
            names, tops, sums = [], [], []
            for lo, hi, data, offsets in chunks(text_column(batch, "__text")):
                grams, bounds, has = features(data, offsets)
                total = np.tile(prior, (hi - lo, 1))
                for k in range(matrix.shape[0]):
                    row = matrix[k]
                    for g, b in zip(grams, bounds):
                        run_sum = np.zeros(len(g) + 1)
                        np.cumsum(row[g], dtype=np.float64, out=run_sum[1:])
                        total[:, k] += np.diff(run_sum[b])
                best = total.argmax(axis=1)
                top = total.max(axis=1)
                names += [langs[j] if ok else None for j, ok in zip(best, has)]
                tops.append(np.where(has, top, -np.inf))
                sums.append(np.where(has, top + np.log(np.exp(total - top[:, None]).sum(axis=1)), -np.inf))
            top, total = np.concatenate(tops), np.concatenate(sums)
            column = {x: i for i, x in enumerate(batch.schema.names)}
            before = batch.column(column["__best"]).to_pylist()
            last_top, last = (batch.column(column[c]).to_numpy() for c in ("__top", "__sum"))
            better = top > last_top
            new = [x if ok else y for x, y, ok in zip(names, before, better)]
            cols = [batch.column(i) for i in range(batch.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(new, pa.string()), pa.array(np.maximum(top, last_top)), pa.array(np.logaddexp(last, total))], batch.schema.names)

    return run


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with lang_pred and score (the posterior of the predicted language).

    Null texts and texts without a letter give ``und`` and 0, as does an empty model. Ties go to the language that
    sorts first. Repeated rows are scored each; other columns are ignored. An empty table gives no rows. A text is
    scored whole, in about 100 bytes of memory for each of its own.
    """
    lowest = F.lit(float("-inf"))
    now = docs.select(*keep, F.col("text").cast("binary").alias("__text"), F.lit(None).cast("string").alias("__best"), lowest.alias("__top"), lowest.alias("__sum"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields)
    for k, block in enumerate(model.blocks()):
        if k and k % BLOCKS_AT_ONCE == 0:
            now = written(now, "language-scores")
        now = now.mapInArrow(lean(_score(docs.sparkSession.sparkContext.broadcast(block))), fields)
    score = F.when(F.col("__best").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("__top") - F.col("__sum"))))
    kept = [f"`{c}`" if c in docs.columns else c for c in keep]
    return now.select(*kept, F.coalesce("__best", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(4) == 2)
    model = train(docs.where("not held_out"))
    found = predict(docs, model, ["doc_id", "held_out"])
    discard(model.counts)
    return found


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Learns from the documents that name their language; documents of no language, or with a posterior under
    ``least``, go: null and empty texts, and those without a letter, are of no language. A null lang becomes the
    predicted one. Repeated rows stay or go together; an empty table gives no rows; other columns stay."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    model = train(docs)
    found = predict(packed, model, ["__row"]).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    discard(model.counts)
    return found.select(*[F.coalesce("__row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"__row.`{c}`") for c in docs.columns])
