"""Exact top-k search by pivot-table elimination.

The pivots are the origin and vectors of a bounded sample, far from each other. Every candidate has its distances to all
of them precomputed, in a table. For a query q and a candidate y the greatest ||q - p| - |y - p|| over the pivots p is a
lower bound on |q - y|, and q.y = (|q|^2 + |y|^2 - |q - y|^2) / 2 turns it into an upper bound on the score (the origin
alone gives |q| |y|). A query's candidates are evaluated in the order of their bounds, best first, until the next bound
is below the k-th best score: no later one can be better, whatever the data. Where bounds are weak, all are evaluated.

How it moves: equal rows are one row with a count. Candidates are dealt into blocks of at most BLOCK_BYTES, queries into
blocks of QUERY_BYTES; a cell of that grid is one group in one worker, so memory is bounded and no pair of rows is ever
a row. A query starts from its scores with the pivots, which are rows too, so a cell returns only what can still be
among the best, at most k rows a query. Work grows as queries times candidates where nothing can be eliminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, lean, lean_cogroup, read_table, written

#: The pivots are chosen among so many rows, the least by a hash.
SAMPLE, PIVOTS = 2048, 24
BLOCK_BYTES, QUERY_BYTES = 16 << 20, 8 << 20
#: Queries whose bounds are worked out side by side; candidates of a query evaluated at once, at first and at most.
LANES, STEP, MOST_STEP = 64, 128, 8192
TASKS = 16384
LIMIT = np.iinfo(np.int64)
K, EVERY, SCALE = 5, 50, 256

_INDEX = "row long, vec_id long, n long, v array<long>, d array<double>"
_QUERIES = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.int64())), ("d", pa.list_(pa.float64())), ("floor", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("times", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("n", pa.int64())])


def scaled(embeddings: DataFrame, vectors: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v, n): floor(scale * x) of each component, equal rows once with their number.

    Vectors that are null or hold a null, NaN or infinite component are left out. Components beyond the range of a
    long become its limit.
    """
    e = F.col(vectors)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return embeddings.where(e.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled with zeros."""
    column = _flat(column)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < np.asarray(column.value_lengths())[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x * x).sum(axis=1)


def far_apart(sample: np.ndarray, most: int) -> list[int]:
    """Places in the sample: each time the vector farthest from the origin and those chosen."""
    x, chosen = sample.astype(np.float64), []
    near = squares(sample)
    while len(chosen) < most and len(x) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Exact but for the root, as long as squares stay below 2**53."""
    return np.sqrt(np.maximum(squares(x)[:, None] - 2 * x.astype(np.float64) @ pivots.T.astype(np.float64) + squares(pivots)[None, :], 0))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integers of any size; beyond the range of a long they become its limit."""
    if len(x) and max(squares(x).max(), squares(q[None, :])[0]) < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([min(max(int(s), LIMIT.min), LIMIT.max) for s in x.astype(object) @ q.astype(object)] if x.shape[1] else [0] * len(x), np.int64)


def best(ids: np.ndarray, null: np.ndarray, count: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that give the k best: by score, then smaller id, a null id last."""
    order = np.lexsort((ids, null, ~scores))  # ~ turns the order round without an overflow
    return order[: int(np.searchsorted(np.cumsum(count[order]), k)) + 1]


class Block:
    """Candidates of one group, searched one query after the other."""

    def __init__(self, table: pa.Table, pivots: np.ndarray, k: int):
        self.k, self.x, self.pivots = k, matrix(table["v"], pivots.shape[1]), pivots
        ids = _flat(table["vec_id"])
        self.ids, self.null = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())
        self.rows, self.count = _flat(table["row"]).to_numpy(), _flat(table["n"]).to_numpy()
        self.table = _flat(table["d"]).flatten().to_numpy().reshape(len(table), len(pivots))
        self.norms = squares(self.x)

    def search(self, rows: np.ndarray, q: np.ndarray, d: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query's place, places here, scores, counts) of what can be among the k best of each query."""
        norms = squares(q)
        size = max(1.0, self.norms.max(initial=0), norms.max(initial=0), squares(self.pivots).max(initial=0))
        if size >= 2.0**53:  # floats no longer hold the scores: no bounds, all are evaluated
            for i in range(len(q)):
                yield i, *self._walk(rows[i], np.arange(len(self.x)), None, lambda at, i=i: products(self.x[at], q[i]), floor[i])
            return
        kind = np.float32 if size < 2.0**24 else np.float64
        x, q, table, d = self.x.astype(kind), q.astype(kind), np.ascontiguousarray(self.table.T.astype(kind)), d.astype(kind)
        margin = (1e-5 if kind is np.float32 else 1e-13) * size + 0.5  # far above the error of the bounds
        for lo in range(0, len(q), LANES):
            part = d[lo : lo + LANES]
            lower = np.abs(part[:, 0, None] - table[0][None, :])
            for j in range(1, len(table)):
                np.maximum(lower, np.abs(part[:, j, None] - table[j][None, :]), out=lower)
            upper = (norms[lo : lo + LANES, None] + self.norms[None, :] - lower.astype(np.float64) ** 2) / 2 + margin
            for i in range(lo, lo + len(part)):
                left = np.flatnonzero(upper[i - lo] >= floor[i])
                order = left[np.argsort(-upper[i - lo][left], kind="stable")]
                yield i, *self._walk(rows[i], order, upper[i - lo], lambda at, i=i: (x[at] @ q[i]).astype(np.int64), floor[i])

    def _walk(self, row: int, order: np.ndarray, upper: np.ndarray | None, score, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held, scores, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step, kth = 0, STEP, floor
        while at < len(order) and (upper is None or upper[order[at]] >= kth):
            new = order[at : at + step]
            n = self.count[new] - (self.rows[new] == row)  # the query's own row is no candidate
            s = score(new)
            keep = (n > 0) & (s >= kth)
            held, scores, counts = np.concatenate([held, new[keep]]), np.concatenate([scores, s[keep]]), np.concatenate([counts, n[keep]])
            if len(held):
                first = best(self.ids[held], self.null[held], counts, scores, self.k)
                held, scores, counts = held[first], scores[first], counts[first]
                if counts.sum() >= self.k:
                    kth = max(kth, int(scores[-1]))
            at, step = at + step, min(2 * step, MOST_STEP)
        return held, scores, counts


def _measure(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch["v"], pivots.shape[1]), pivots)
            table = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], batch["n"], batch["v"], table], ["row", "vec_id", "n", "v", "d"])

    return run


def _floors(rows: np.ndarray, vectors: np.ndarray, counts: np.ndarray, k: int):
    """Adds the k-th best score among the pivots' rows, where they are so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, own, floor = matrix(batch["v"], vectors.shape[1]), batch["row"].to_numpy(), []
            for i in range(len(q)):
                n = counts - (rows == own[i])
                scores = products(vectors, q[i])
                order = np.argsort(~scores, kind="stable")
                up_to = np.cumsum(n[order])
                floor.append(int(scores[order[np.searchsorted(up_to, k)]]) if len(up_to) and up_to[-1] >= k else LIMIT.min)
            yield pa.RecordBatch.from_arrays([*(batch[c].cast(_QUERIES.field(c).type) for c in ("row", "vec_id", "n", "v", "d")), pa.array(floor, pa.int64())], schema=_QUERIES)

    return run


def _cells(pivots: np.ndarray, k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            return _FOUND.empty_table()
        block = Block(candidates, pivots, k)
        rows, ids, times = (_flat(queries[c]).to_numpy() for c in ("row", "vec_id", "n"))
        d = _flat(queries["d"]).flatten().to_numpy().reshape(len(queries), len(pivots))
        found: list[list] = [[np.zeros(0, np.int64)] for _ in range(6)]
        for i, at, scores, counts in block.search(rows, matrix(queries["v"], pivots.shape[1]), d, _flat(queries["floor"]).to_numpy()):
            for to, v in zip(found, (np.full(len(at), rows[i]), np.full(len(at), ids[i]), np.full(len(at), times[i]), at, scores, counts)):
                to.append(v)
        row, query, times, at, scores, counts = (np.concatenate(c).astype(np.int64) for c in found)
        return pa.Table.from_arrays([pa.array(row), pa.array(query), pa.array(times), pa.array(block.ids[at], mask=block.null[at]), pa.array(scores), pa.array(counts)], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, queries: str, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest inner product for each row that ``queries`` (SQL) takes.

    ``vectors`` is (vec_id, v array<long>, n): equal rows once, with their number. Every row is a candidate but the
    query's own (its copies are candidates); ties go to the smaller vec_id, a null one comes last. A repeated query
    gives its rows as often. Vectors of different lengths agree in their common components only. Scores beyond the
    range of a long become its limit. Fewer candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "n", "v"), "topk-rows")
    total, width = rows.agg(F.sum(F.size("v") * 8 + 8 * pivots), F.max(F.size("v"))).first()
    width = width or 0
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(SAMPLE).toArrow()
    x = matrix(sample["v"], width)
    chosen = far_apart(x, pivots)
    at = np.vstack([np.zeros((1, width), np.int64), x[chosen]])
    index = written(rows.mapInArrow(lean(_measure(at)), _INDEX), "topk-index")
    floors = _floors(_flat(sample["row"]).to_numpy()[chosen], x[chosen], _flat(sample["n"]).to_numpy()[chosen], k)
    asked = written(index.where(queries).mapInArrow(lean(floors), _INDEX + ", floor long"), "topk-queries")
    wanted = asked.agg(F.sum(F.size("v") * 8 + 8 * pivots)).first()[0]
    down = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // BLOCK_BYTES))
    across = max(1, -(-int(wanted or 0) // QUERY_BYTES))
    tasks = min(down * across, TASKS)
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    cell = F.col("down") * across + F.col("across")
    left = index.withColumns({"down": block(down), "across": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))}).withColumn("cell", cell).drop("down", "across")
    right = asked.withColumns({"across": block(across), "down": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))}).withColumn("cell", cell).drop("down", "across")
    by_cell = lambda df: df.repartitionById(tasks, F.col("cell")).groupBy("cell")
    found = by_cell(left).cogroup(by_cell(right)).applyInArrow(lean_cogroup(_cells(at, k)), "row long, query_id long, times long, vec_id long, score long, n long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = found.withColumn("up_to", F.sum("n").over(order)).withColumn("from", F.col("up_to") - F.col("n") + 1).where(F.col("from") <= k)
    each = ranked.select("query_id", "times", "vec_id", "score", F.explode(F.sequence("from", F.least("up_to", F.lit(k)))).alias("rank"))
    # a query that stands in many rows: first by thousands, then the rest
    thousands = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 1000))).alias("m"))
    repeated = thousands.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000), F.col("times") - 1000 * F.col("m")))).alias("t"))
    out = written(repeated.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-found")
    for t in (rows, index, asked):
        discard(t)
    return out


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled(read_table(spark, sf_dir, "embeddings")), f"vec_id % {EVERY} = 0")


OP11_SQL = f"""
with v as (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.r, q.vec_id query_id, c.vec_id, cast(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) as bigint) score
  from v q join v c on q.r <> c.r where q.vec_id % {EVERY} = 0
)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as int) as rank, vec_id, score from s
qualify row_number() over (partition by r order by score desc, vec_id nulls last) <= {K}
"""
