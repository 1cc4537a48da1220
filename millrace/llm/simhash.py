"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a (shortened) word of the perfect
(23, 12) Golay code. A word within distance 2 of its codeword is keyed by that codeword's index; a word at
distance 3 also by the five codewords at distance 4. Two words that differ in at most one bit then share a key.

Pigeonhole: four errors over three segments leave two segments with at most one error each, or are split 2, 2, 0.
So two fingerprints within distance 4 share the keys of some pair of segments, or agree in a whole segment. Both
kinds of key are joined and every candidate is verified on the full fingerprints.

Only distinct fingerprints take part, so exact copies cost nothing. A bucket yields a spanning forest of its
links, never all pairs. A bucket of over ``BUCKET_ROWS`` is dealt out anew in pairs of blocks, so that none is
compared in one task and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import lean, read_table, text_column, written
from millrace.llm.components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code.
GOLAY = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Rows of a bucket compared in one task, rows of a block beyond, and the run length up to which rows are shifted.
BUCKET_ROWS, BLOCK_ROWS, SHORT_RUN = 8192, 4096, 24


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)  # of one hash every bit has the majority
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, len(first), 1 << 14):
        part = [digest(joined[a:b], SEED) for a, b in zip(first[lo : lo + (1 << 14)].tolist(), last[lo : lo + (1 << 14)].tolist())]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = (2 * ones > len(first)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = text_column(batch, "text")
        found = np.fromiter((fingerprint(x.as_py()) for x in text), dtype=np.uint64, count=len(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; texts without words and null texts have 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(_fingerprints), "doc_id long, fp long")


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; per syndrome the error of weight 0 to 3, whether it weighs 3, and the five of weight 4."""

    def rest(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GOLAY << (k - 11)
        return v

    low = np.array([rest(v) for v in range(1 << 12)], dtype=np.int32)
    high = np.array([rest(v << 12) for v in range(1 << 11)], dtype=np.int32)
    single = [rest(1 << k) for k in range(23)]
    near, heavy = np.zeros(1 << 11, np.int32), np.zeros(1 << 11, bool)
    far: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome, error = 0, 0
            for k in places:
                syndrome ^= single[k]
                error |= 1 << k
            if weight < 4:
                near[syndrome], heavy[syndrome] = error, weight == 3
            else:
                far[syndrome].append(error)
    five = np.array([(x + [0] * 5)[:5] for x in far], dtype=np.int32)
    return low, high, near, heavy, five


def segment_keys(values: np.ndarray) -> np.ndarray:
    """Indices of the codewords near each 23-bit value, six columns, -1 where there are fewer."""
    low, high, near, heavy, five = _code()
    syndrome = low[values & 0xFFF] ^ high[values >> 12]
    out = np.full((len(values), 6), -1, dtype=np.int32)
    out[:, 0] = (values ^ near[syndrome]) >> 11
    more = heavy[syndrome]
    out[more, 1:] = (values[more, None] ^ five[syndrome[more]]) >> 11
    return out


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (int32) and the row of each: pairs of Golay indices for the pairs of segments, then whole segments."""
    fps = fps.view(np.uint64)
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int32) for at, width in SEGMENTS]
    golay = [segment_keys(p) for p in parts]
    keys, rows = [], []
    for t, (i, j) in enumerate(PAIRS):
        both = (t << 24) | (golay[i][:, :, None] << 12) | golay[j][:, None, :]
        real = (golay[i][:, :, None] >= 0) & (golay[j][:, None, :] >= 0)
        row = np.broadcast_to(np.arange(len(fps), dtype=np.int64)[:, None, None], real.shape)
        keys.append(both[real])
        rows.append(row[real])
    for t, p in enumerate(parts, len(PAIRS)):
        keys.append((t << 24) | p)
        rows.append(np.arange(len(fps), dtype=np.int64))
    return np.concatenate(keys).astype(np.int32), np.concatenate(rows)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for lo in range(0, len(fps), 4096):
            part = fps[lo : lo + 4096]
            keys, rows = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: each one found is compared with those not yet found."""
    left, a, b = fps.view(np.uint64), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys: all of a short run, a spanning forest of a longer one."""
    n = len(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, n))
    a, b = [], []
    long_run = size > SHORT_RUN
    for s, m in zip(edge[long_run], size[long_run]):
        x, y = forest(np.unique(fps[s : s + m]))
        a.append(x)
        b.append(y)
    short = np.repeat((size > 1) & ~long_run, size)
    keys, fps = keys[short], fps[short]
    for d in range(1, SHORT_RUN):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        x, y = fps[same], fps[same + d]
        near = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= DISTANCE) & (x != y)
        a.append(x[near])
        b.append(y[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rows(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key.astype(np.int32)), pa.array(a), pa.array(b)], ["kind", "key", "a", "b"])


def _link(most: int | None):
    """Links of rows sorted by key. Rows of a key with over ``most`` rows come back as they are, with kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int32), np.zeros(0, np.int64)
        hot = None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            if hot is not None:
                end = int(np.searchsorted(keys, hot, side="right"))
                yield _rows(1, keys[:end], fps[:end], fps[:end])
                keys, fps = keys[end:], fps[end:]
                if not len(keys):
                    continue
                hot = None
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield from done(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if most and len(keys) > most:
                hot = keys[-1]
                yield _rows(1, keys, fps, fps)
                keys, fps = keys[:0], fps[:0]
        yield from done(keys, fps)

    def done(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if most and len(keys):
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(edge, len(keys)))
            big = np.repeat(size > most, size)
            if big.any():
                yield _rows(1, keys[big], fps[big], fps[big])
                keys, fps = keys[~big], fps[~big]
        a, b = links(keys, fps)
        if len(a):
            yield _rows(0, np.zeros(len(a), np.int32), a, b)

    return run


def near_links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within DISTANCE; fps: distinct longs in a column fp."""
    spark = fps.sparkSession
    dealt = fps.select("fp").mapInArrow(lean(_deal), "key int, fp long")
    schema = "kind int, key int, a long, b long"
    found = written(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_link(bucket_rows)), schema), "simhash-links")
    out = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select("key", F.col("a").alias("fp"))
    if hot.limit(1).count():
        blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = (
            hot.join(blocks, "key")
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "fp")
        )
        more = pairs.repartition("task").sortWithinPartitions("task").mapInArrow(lean(_link_tasks), "a long, b long")
        out = out.union(more)
    return out


def _link_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _link, for pairs of blocks: 64-bit keys, each with rows of two blocks at most."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done(keys, fps):
        a, b = links(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield done(keys[:cut], fps[:cut])
        keys, fps = keys[cut:], fps[cut:]
    yield done(keys, fps)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id (the smallest doc_id of its component).

    Null texts and texts without words have fingerprint 0 and link like any other. A null doc_id takes part but
    never names a component, unless no row of the component has another. Rows that share a doc_id are linked by
    their fingerprints only. An empty table gives no rows; other columns are ignored.
    """
    each = written(fingerprints(docs), "simhash-fingerprints")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_links(fps)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return each.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component. Rows that repeat a doc_id are one document:
    they stay together or go together."""
    found = near_duplicates(docs)
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")
