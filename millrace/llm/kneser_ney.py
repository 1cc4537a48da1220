"""Quality classifier: interpolated modified Kneser-Ney over character 4-grams of trusted text.

A 4-gram is exact: its three first code points are one long, its last an int; 0 stands for the ends of a text. Counts,
continuation counts, contexts and probabilities of every order are tables, joined by n-gram and sharded by it. The
corpus's distinct 4-grams are looked up in these by joins, with back-off to the lower orders for those that trusted
text lacks. Documents are dealt into chunks by a hash of id and text, as many as keep a chunk's text in CHUNK_BYTES; a
chunk sends each of its distinct 4-grams once, fetches their answers, and sums them over each text: its perplexity. A document
is kept if that is at most its language's quantile among the trusted documents. Two models are fitted, on a half of
the trusted documents each, and none of these is judged by the half that it is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import sketch
from millrace.llm.common import MASK64, STEP_A, chunk_count, chunks, discard, lean, lean_cogroup, lean_group, mix, read_table, text_column, written
from millrace.llm.substring import _binary

ORDER, BITS = 4, 21
#: Rank of the threshold among a language's trusted documents, and of how many of these its own quantile is half the threshold.
RANK, BLEND = 0.995, 50
#: Rows (of two or three numbers) up to which a counted table is broadcast.
BROADCAST_ROWS = 1_000_000
#: Distinct n-grams that a task holds before it sends them on.
HELD_GRAMS = 1_000_000
#: Rounds in which the chunks are taken if all cores have one in each: so little of the texts is in shuffle files at a time.
ROUNDS = 4


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, and where each text's begin (texts + 1)."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    if before[-1] == len(data) and not (data & 0x80).any():
        return data, offsets
    read = lambda x: np.frombuffer(x.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    whole = read(data)
    if len(whole) == before[-1]:
        return whole, before[offsets]
    parts = [read(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]  # ill-formed bytes: text by text
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and symbol of the 4-gram that ends at each character of each text and at its end, and where each text's begin."""
    data, offsets = points(data, offsets)
    texts = np.arange(len(offsets))
    # zeros stand before each text, and the first of the next ones ends it
    zeros = (offsets + texts * (ORDER - 1))[:, None] + np.arange(ORDER - 1)
    solid = np.ones(len(data) + len(texts) * (ORDER - 1), bool)
    solid[zeros] = False
    symbols = np.zeros(len(solid), dtype=np.int64)
    symbols[solid] = data
    symbols[solid] += 1
    symbols = symbols[: 2 - ORDER]
    context = (symbols[:-3] << (2 * BITS)) | (symbols[1:-2] << BITS) | symbols[2:-1]
    mine = np.ones(len(context), bool)
    mine[zeros[1:-1, 1:] - (ORDER - 1)] = False  # would end at a zero beyond a text's end
    return context[mine], symbols[ORDER - 1 :][mine].astype(np.int32), offsets + texts


def _keys(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A well mixed key of each 4-gram. Two with the same key and the same last symbol are equal."""
    return mix(context.view(np.uint64)) ^ (symbol.astype(np.uint64) * np.uint64(STEP_A))


class Grams:
    """The distinct ones of some 4-grams in the order of their keys, found from the first bits of these. Equal ones that
    another with the same key sets apart, by chance, stay two."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray):
        key = _keys(context, symbol)
        self.order = np.argsort(key)
        key, symbol = key[self.order], symbol[self.order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (symbol[1:] != symbol[:-1])
        self.begin = np.flatnonzero(new)
        self.place = self.order[self.begin]  # of the first of each among those given
        self.context, self.symbol = context[self.place], symbol[self.begin]
        # one more that equals none ends them
        self._key, self._symbol = np.append(key[self.begin], np.uint64(MASK64)), np.append(self.symbol, np.int32(-1))
        bits = min(len(self).bit_length() + 2, 22)
        self._shift = np.uint64(64 - bits)
        size = np.bincount((self._key[:-1] >> self._shift).view(np.int64), minlength=1 << bits)
        self._first = (np.cumsum(size) - size).astype(np.int32)

    def __len__(self) -> int:
        return len(self.begin)

    def sums(self, n: np.ndarray) -> np.ndarray:
        """What the equal ones of those given have together."""
        return np.add.reduceat(n[self.order], self.begin)

    def find(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The place of each 4-gram; the length for one that is not here."""
        key = _keys(context, symbol)
        at = self._first[(key >> self._shift).view(np.int64)]
        left = np.flatnonzero((self._key[at] != key) | (self._symbol[at] != symbol))
        while len(left):
            on = (at[left] < len(self)) & (self._key[at[left]] <= key[left])
            at[left[~on]] = len(self)
            left = left[on]
            at[left] += 1
            left = left[(self._key[at[left]] != key[left]) | (self._symbol[at[left]] != symbol[left])]
        return at


class Counts:
    """Counts of 4-grams: known ones are added up in place, new ones wait until they are a quarter of the known."""

    def __init__(self):
        self.grams, self.n = Grams(np.zeros(0, np.int64), np.zeros(0, np.int32)), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, context: np.ndarray, symbol: np.ndarray) -> None:
        at = self.grams.find(context, symbol)
        self.n += np.bincount(at, minlength=len(self.grams) + 1)[:-1]
        new = np.flatnonzero(at == len(self.grams))
        if len(new):
            found = Grams(context[new], symbol[new])
            self.new.append((found.context, found.symbol, found.sums(np.ones(len(new), np.int64))))
            if sum(len(x[2]) for x in self.new) > len(self.grams) // 4:
                self.merge()

    def merge(self) -> None:
        context, symbol, n = (np.concatenate(x) for x in zip((self.grams.context, self.grams.symbol, self.n), *self.new))
        self.new.clear()
        self.grams = Grams(context, symbol)
        self.n = self.grams.sums(n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the 4-grams of all texts."""

    def done() -> pa.RecordBatch:
        held.merge()
        return pa.RecordBatch.from_arrays([pa.array(held.grams.context), pa.array(held.grams.symbol), pa.array(held.n)], ["context", "symbol", "n"])

    held = Counts()
    for batch in batches:
        for _, _, data, offsets in chunks(text_column(batch, "text")):
            context, symbol, _ = grams(data, offsets)
            held.add(context, symbol)
            if len(held.grams) > HELD_GRAMS:
                yield done()
                held = Counts()
    if len(held.grams):
        yield done()


def counts_of(texts: DataFrame) -> DataFrame:
    """(context, symbol, n) of all 4-grams of the column text."""
    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(_count), "context long, symbol int, n long")
    return rows.groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def shorter(order: int) -> Column:
    """The context of the gram one symbol shorter, without the first symbol."""
    return F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 2))) - 1 if order > 1 else 0))


def bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted here, are few enough; else it is shuffled by n-gram."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Model:
    """Tables of the orders from 1: probabilities (context, symbol, p) and back-off weights (context, g)."""

    def __init__(self, texts: DataFrame):
        level = written(counts_of(texts), "kneser-ney-counts")
        self.tables = [level]
        levels = {ORDER: level}
        for order in range(ORDER, 1, -1):  # continuation counts: distinct grams one symbol longer
            level = written(level.groupBy(shorter(order).alias("context"), "symbol").agg(F.count("*").alias("n")), "kneser-ney-counts")
            self.tables.append(level)
            levels[order - 1] = level
        self.p: dict[int, DataFrame] = {}
        self.g: dict[int, DataFrame] = {}
        self.unknown = 1.0
        for order in range(1, ORDER + 1):
            self._fit(order, levels[order])

    def _fit(self, order: int, level: DataFrame) -> None:
        row = level.agg(F.count("*"), *[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
        rows, n1, n2, n3, n4 = (float(x) for x in row)
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        discount = [max(0.0, min(k, k - (k + 1) * y * b / a)) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        less = F.when(F.col("n") == 1, discount[0]).when(F.col("n") == 2, discount[1]).otherwise(discount[2])
        contexts = written(level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(less) / F.sum("n")).alias("g")), "kneser-ney-contexts")
        own = level.join(contexts, "context").select("context", "symbol", ((F.col("n") - less) / F.col("total")).alias("own"), "g")
        if order == 1:  # below are all symbols of trusted text, and one for the others
            found = contexts.first()
            self.unknown = (found["g"] if found else 1.0) / (rows + 1)
            p = own.select("context", "symbol", (F.col("own") + F.lit(self.unknown)).alias("p"))
        else:
            lower = self.p[order - 1].select(F.col("context").alias("l_context"), F.col("symbol").alias("l_symbol"), F.col("p").alias("l_p"))
            met = own.withColumn("s_context", shorter(order)).join(lower, (F.col("s_context") == F.col("l_context")) & (F.col("symbol") == F.col("l_symbol")))
            p = met.select("context", "symbol", (F.col("own") + F.col("g") * F.col("l_p")).alias("p"))
        self.p[order], self.g[order] = written(p, "kneser-ney-shares"), contexts
        self.tables += [self.p[order], contexts]

    def answers(self, wanted: DataFrame, order: int = ORDER) -> DataFrame:
        """(context, symbol, p) of distinct grams: their own probability, or their context's weight times the shorter gram's."""
        if order == 1:
            found = wanted.join(self.p[1].select("symbol", "p"), "symbol", "left")
            return found.select("context", "symbol", F.coalesce("p", F.lit(self.unknown)).alias("p"))
        looked = written(wanted.join(self.p[order], ["context", "symbol"], "left"), "kneser-ney-looked")
        self.tables.append(looked)
        missing = looked.where("p is null").select("context", "symbol", shorter(order).alias("s_context"))
        lower = self.answers(missing.select(F.col("s_context").alias("context"), "symbol").distinct(), order - 1)
        lower = lower.select(F.col("context").alias("l_context"), F.col("symbol").alias("l_symbol"), F.col("p").alias("l_p"))
        met = missing.join(lower, (F.col("s_context") == F.col("l_context")) & (F.col("symbol") == F.col("l_symbol"))).join(self.g[order], "context", "left")
        backed = met.select("context", "symbol", (F.coalesce("g", F.lit(1.0)) * F.col("l_p")).alias("p"))
        return looked.where("p is not null").select("context", "symbol", "p").union(backed)

    def drop(self) -> None:
        for table in self.tables:
            discard(table)


def _seen(table: pa.Table) -> pa.Table:
    """The distinct 4-grams of a chunk's texts."""
    held = Counts()
    for _, _, data, offsets in chunks(_binary(table.column("text"))):
        context, symbol, _ = grams(data, offsets)
        held.add(context, symbol)
    held.merge()
    chunk = np.full(len(held.grams), table.column("chunk")[0].as_py(), np.int32)
    return pa.Table.from_arrays([pa.array(chunk), pa.array(held.grams.context), pa.array(held.grams.symbol)], ["chunk", "context", "symbol"])


def _score(names: list[str]):
    """The sums of a chunk's texts over the logarithms of their 4-grams, which the other table has."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = Grams(*(right.column(c).to_numpy() for c in ("context", "symbol")))
        logs = [right.column(c).to_numpy()[known.place] for c in names]
        size, sums = [np.zeros(0, np.int64)], [[np.zeros(0)] for _ in names]
        for _, _, data, offsets in chunks(_binary(left.column("text"))):
            context, symbol, begin = grams(data, offsets)
            at = known.find(context, symbol)
            size.append(np.diff(begin))
            for log, parts in zip(logs, sums):
                parts.append(np.add.reduceat(log[at], begin[:-1]))
        cols = [pa.array(np.concatenate(x)) for x in (size, *sums)]
        return pa.Table.from_arrays([*(left.column(c) for c in ("doc_id", "lang", "has_text")), *cols], ["doc_id", "lang", "has_text", "n_symbols", *names])

    return run


def log_probabilities(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, lang, has_text, n_symbols (characters and the end) and log_0, log_1, ... by each model, of each row; a
    null text is empty."""
    parts, names = chunk_count(docs), [f"log_{k}" for k in range(len(models))]
    rounds = max(1, min(ROUNDS, parts // docs.sparkSession.sparkContext.defaultParallelism))
    size = -(-parts // rounds)
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(size * rounds)).cast("int")
    rows = docs.select(
        (dealt % rounds).alias("round"), F.floor(dealt / rounds).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        (F.length(F.coalesce("text", F.lit(""))) > 0).alias("has_text"), F.col("text").cast("binary").alias("text"),
    )
    by_chunk = lambda df: df.repartitionById(size, F.col("chunk")).groupBy("chunk")
    of_round = [rows.where(F.col("round") == k).drop("round") for k in range(rounds)]
    seen = [written(by_chunk(x.select("chunk", "text")).applyInArrow(lean_group(_seen), "chunk int, context long, symbol int"), "kneser-ney-seen") for x in of_round]
    wanted = written(reduce(DataFrame.union, seen).select("context", "symbol").distinct(), "kneser-ney-wanted")
    answers = wanted
    for name, model in zip(names, models):
        answers = answers.join(model.answers(wanted).select("context", "symbol", F.log("p").alias(name)), ["context", "symbol"])
    answers = written(answers, "kneser-ney-answers")
    fields = "doc_id long, lang string, has_text boolean, n_symbols long" + "".join(f", {x} double" for x in names)
    found, known = [], bounded(answers)
    for x, its in zip(of_round, seen):
        told = by_chunk(its.join(known, ["context", "symbol"]))
        found.append(written(by_chunk(x).cogroup(told).applyInArrow(lean_cogroup(_score(names)), fields), "kneser-ney-scored"))
    for table in (*seen, wanted, answers):
        discard(table)
    return reduce(DataFrame.union, found)


def classify(docs: DataFrame, labels: DataFrame, trusted: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_symbols, perplexity, threshold, kept.

    Trusted are documents labelled of quality and not toxic; repeated labels count once. The models are fitted on
    all of them (with ``trusted``, on so many with the smallest hashes), halved by a hash; a trusted document is scored by the other half's, any other by the
    mean of both logarithms. Thresholds are taken over all trusted documents: a language's own quantile, blended with
    that over all by its number of these (half of each at BLEND, none of its own without any; null is a language).
    Without trusted documents everything is kept. Empty and null texts are not kept. A perplexity equal to the
    threshold is kept. Repeated rows are scored each. A very long text is as many 4-grams as it has characters. An
    empty table gives no rows; other columns are ignored.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")
    chosen = written(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().select("doc_id", half), "kneser-ney-trusted")
    ids = chosen if trusted is None else written(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted), "kneser-ney-fitted")
    own_docs = docs.select("doc_id", "lang", "text")
    texts = own_docs.join(bounded(ids), "doc_id").where("text is not null")
    models = [Model(texts.where(F.col("half") == k)) for k in (0, 1)]
    scored = log_probabilities(own_docs, models).join(chosen, "doc_id", "left")
    log_p = F.when(F.col("half") == 0, F.col("log_1")).when(F.col("half") == 1, F.col("log_0")).otherwise((F.col("log_0") + F.col("log_1")) / 2)
    scored = written(scored.select("doc_id", "lang", "has_text", "n_symbols", F.exp(-log_p / F.col("n_symbols")).alias("perplexity"), F.col("half").isNotNull().alias("trusted")), "kneser-ney-perplexities")
    for model in models:
        model.drop()
    langs = sketch.sketch(scored.where("has_text and trusted"), ["lang"], ["perplexity"])
    whole = sketch.quantiles(sketch.merge(langs, []), [], {"t": RANK}).first()
    own = sketch.quantiles(langs, ["lang"], {"own": RANK}).select(F.col("lang").alias("t_lang"), "own", (F.col("total") / (F.col("total") + BLEND)).alias("share"))
    joined = scored.join(bounded(written(own, "kneser-ney-thresholds")), F.col("lang").eqNullSafe(F.col("t_lang")), "left")
    t = F.lit(float(whole["t"]) if whole else float("inf"))
    threshold = F.when(F.col("own").isNull(), t).otherwise(F.exp(F.col("share") * F.log("own") + (1 - F.col("share")) * F.log(t)))
    out = joined.select("doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"), (F.col("has_text") & (F.col("perplexity") <= threshold)).alias("kept"))
    discard(ids)
    return out


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
