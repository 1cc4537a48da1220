"""Periodic run detection on a harmonic grid.

A run of period p and length of at least 4p holds 3p consecutive places i whose words at i and i + p agree, so one of
every 3p places (for p = 1, of every five) tells. Over all p that are n / 3 * (1 + 1/2 + 1/3 ...) pairs of a period and
a grid point. They are extended all at once: the words are numbered, prefix hashes of the numbers modulo two primes
compare any two stretches, and a binary search per pair finds how far the agreement goes either way. Pairs that give
the same stretch are one run, whose period is the smallest of them. Every run is then compared word for word, with the
words beside it; where a hash has lied, the texts are searched again with other bases.

How it moves: nothing is shuffled, a text is a row. A worker takes about a quarter of a megabyte of texts, or one long
text, and PAIRS pairs at a time, shortest periods first: pairs that lie within a run of a divisor of their period are
known and are left out, so a text of one word costs no more than others.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import CRC32_TABLE_SQL, chunks, crc32_sql, id_string, lean, mix, read_table, spread, text_column, word_numbers, words

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Pairs of a period and a grid point that are extended at once.
PAIRS = 1 << 19
#: The two largest primes below 2**31: products of residues stay below 2**62.
PRIMES = (2147483647, 2147483629)

Reorder = Callable[[list, np.ndarray], np.ndarray]


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**k modulo the prime for k <= n, doubled from what is known."""
    out, have = np.ones(n + 1, np.uint64), 1
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


class Prefixes:
    """Prefix hashes of a sequence of numbers: whether the stretches of n at a and at a + p agree."""

    def __init__(self, values: np.ndarray, longest: int, seed: int):
        symbol = mix(values.astype(np.uint64) + np.uint64(seed * 2 + 1))
        self.levels = []
        for k, prime in enumerate(PRIMES):
            base = 1_000_003 + 2 * (seed * len(PRIMES) + k)
            up, m = _powers(base, prime, max(longest, len(values))), np.uint64(prime)
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(symbol % m * up[: len(values)] % m, out=total[1:])
            total %= m
            self.levels.append((total, up, m))

    def agree(self, a: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, b = np.ones(len(a), bool), a + p
        for total, up, m in self.levels:
            left = (total[a + n] + m - total[a]) % m * up[p] % m
            out &= left == (total[b + n] + m - total[b]) % m
        return out


def _grid(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, step, points) of every period of every text, shortest periods first."""
    most = np.where(n >= LEAST_WORDS, n // LEAST_TIMES, 0)
    text = np.repeat(np.arange(len(n)), most)
    period = spread(np.ones(len(n), np.int64), most)
    order = np.argsort(period, kind="stable")
    text, period = text[order], period[order]
    step = np.maximum(LEAST_WORDS, LEAST_TIMES * period) - period
    return text, period, step, (n[text] - period) // step


def _reach(test: Callable, most: np.ndarray) -> np.ndarray:
    """For each place the greatest n <= most that the test takes, all searched at once."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_] + 1) // 2
        ok = test(open_, mid)
        low[open_] = np.where(ok, mid, low[open_])
        high[open_] = np.where(ok, high[open_], mid - 1)
    return low


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs over the same stretch the one of the smallest period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def _true(values: np.ndarray, begin: np.ndarray, stop: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray, part: int = 1 << 21) -> bool:
    """Whether every run has its period, word for word, and no neighbouring word of its text goes on with it."""
    if ((start > begin) & (values[np.maximum(start - 1, 0)] == values[start - 1 + period])).any():
        return False
    if ((end < stop) & (values[np.minimum(end, len(values) - 1)] == values[end - period])).any():
        return False
    size, lo = end - start - period, 0
    up_to = np.cumsum(size)
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(up_to, (up_to[lo - 1] if lo else 0) + part, side="right")))
        at = spread(start[lo:hi], size[lo:hi])
        if (values[at] != values[at + np.repeat(period[lo:hi], size[lo:hi])]).any():
            return False
        lo = hi
    return True


def _search(values: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(start, end, period) of the runs of all texts by start and end, or nothing where two stretches share a hash."""
    text, period, step, points = _grid(np.diff(first))
    found: list[tuple] = []
    if not len(text):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    hashes = Prefixes(values, int(period[-1]), seed)
    known_period, known_end, known_size = (np.zeros(len(values), np.int64) for _ in range(3))
    up_to, lo = np.cumsum(points), 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(up_to, (up_to[lo - 1] if lo else 0) + PAIRS, side="right")))
        count = points[lo:hi]
        rep = lambda x: np.repeat(x[lo:hi], count)  # noqa: B023, E731
        p, t = rep(period), rep(step)
        begin, stop = rep(first[:-1][text]), rep(first[1:][text])
        x = begin + (spread(np.ones(hi - lo, np.int64), count)) * t - 1
        keep = np.flatnonzero(values[x] == values[x + p])
        x, p, t, begin, stop = x[keep], p[keep], t[keep], begin[keep], stop[keep]
        # at least half of a stretch of t places lies before the grid point or after it
        half, ahead, back = (t + 1) // 2, np.zeros(len(x), bool), np.zeros(len(x), bool)
        fits = np.flatnonzero(x + p + half <= stop)
        ahead[fits] = hashes.agree(x[fits], p[fits], half[fits])
        fits = np.flatnonzero(~ahead & (x - half >= begin))
        back[fits] = hashes.agree(x[fits] - half[fits], p[fits], half[fits])
        inside = (known_period[x] > 0) & (p % np.maximum(known_period[x], 1) == 0) & (x + p < known_end[x])
        keep = np.flatnonzero((ahead | back) & ~inside)
        x, p, t, begin, stop = x[keep], p[keep], t[keep], begin[keep], stop[keep]
        onward = _reach(lambda i, n: hashes.agree(x[i], p[i], n), stop - x - p)  # noqa: B023
        before = _reach(lambda i, n: hashes.agree(x[i] - n, p[i], n), x - begin)  # noqa: B023
        long = np.flatnonzero(onward + before >= t)
        run = _distinct((x - before)[long], (x + onward + p)[long], p[long])
        own = np.searchsorted(first, run[0], side="right") - 1
        if not _true(values, first[own], first[own + 1], *run):
            return None
        found.append(run)
        # runs that multiples of their period would find again
        size = run[1] - run[0]
        order = np.flatnonzero(size >= 2 * LEAST_TIMES * run[2])
        order = order[np.argsort(size[order], kind="stable")]
        at = spread(run[0][order], size[order])
        period_at, end_at, size_at = (np.repeat(v[order], size[order]) for v in (run[2], run[1], size))
        longer = size_at > known_size[at]
        at = at[longer]
        known_period[at], known_end[at], known_size[at] = period_at[longer], end_at[longer], size_at[longer]
        lo = hi
    return _distinct(*(np.concatenate(c) for c in zip(*found)))


def runs_of(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run in texts of numbered words that begin at ``first`` (length texts + 1).

    A run is a maximal stretch with smallest period p, of at least 6 words and 4 periods; its places are those in
    ``values``.
    """
    return next(found for seed in itertools.count() if (found := _search(values, first, seed)) is not None)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("id", pa.string()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.large_binary())])


def _find(reorder: Reorder | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_column(batch, "text")
            for lo, hi, data, offsets in chunks(texts):
                starts, ends, first = words(data, offsets)
                if reorder is not None:
                    order = reorder(ids[lo:hi], first)
                    starts, ends = starts[order], ends[order]
                if len(starts):
                    start, end, period = runs_of(word_numbers(data, starts, ends), first)
                else:
                    start = end = period = np.zeros(0, np.int64)
                own = np.searchsorted(first, start, side="right") - 1
                drop = np.bincount(start + period, minlength=len(starts) + 1) - np.bincount(end, minlength=len(starts) + 1)
                kept = np.flatnonzero(np.cumsum(drop)[: len(starts)] == 0)
                size = ends[kept] - starts[kept]
                at = np.cumsum(size + 1) - size - 1
                packed = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
                packed[spread(at, size)] = data[spread(starts[kept], size)]
                # each text's words end before a space that is not part of it
                edges = np.concatenate([at, [len(packed)]])[np.searchsorted(kept, first)]
                raw = packed.tobytes()
                collapsed = [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:])]
                inner = pa.StructArray.from_arrays([pa.array(start - first[own]), pa.array(end - start), pa.array(period)], fields=list(_RUNS.value_type))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(hi - lo + 1)).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.string()), pa.array(np.diff(first)), runs.cast(_RUNS), pa.array(collapsed, pa.large_binary())], schema=_SCHEMA)

    return run


def periodic_runs(docs: DataFrame, reorder: Reorder | None = None) -> DataFrame:
    """Per row of ``docs``: id (the doc_id as text), n_words, runs (start, length, period; by start, then period) and
    collapsed (the words joined by one space, without those that a run holds after its first period).

    ``reorder`` may put other words in the places of a text: from the ids and the place where each text's words
    begin it gives the number of the word for every place, in the same text. Null and empty texts have no words, no
    runs and an empty text; a null doc_id stays null; repeated rows fare alike; an empty table gives no rows; other
    columns are ignored. Nothing is shuffled; a text must fit in a worker's memory several times over.
    """
    return docs.select(id_string().alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(_find(reorder)), "id string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    )


def repeat_planted(ids: list, first: np.ndarray) -> np.ndarray:
    """The contract's texts: where crc32 of the id ends in 0, the words from a on repeat with a period p.

    With h the crc32 (a null id: of the empty text), g = h // 10 and n words: a = g % n, p = 1 + (n - a) // (3 + g % 8).
    """
    n = np.diff(first)
    h = np.array([zlib.crc32((i or "").encode()) for i in ids], np.int64)
    g = h // 10
    a = g % np.maximum(n, 1)
    p = 1 + (n - a) // (3 + g % 8)
    a = np.where(h % 10 == 0, a, n)  # the others repeat nothing
    a, p, begin = (np.repeat(v, n) for v in (a, p, first[:-1]))
    place = np.arange(int(first[-1])) - begin
    return begin + np.where(place >= a, a + (place - a) % p, place)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    found = periodic_runs(docs, repeat_planted).withColumns({"best": longest, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return found.select(
        F.col("id").cast(kind).alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_WORD = r"[^\x20\x09-\x0D]+"

#: Pairs of equal words instead of a grid: every (i, j) of one word in a text with j - i at most a quarter of it.
OP12_SQL = f"""
with {CRC32_TABLE_SQL}
, d as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) w, {crc32_sql("doc_id")} h from documents, crc32_table
), s as (
  select r, doc_id, w, len(w) n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % greatest(len(w), 1) else len(w) end a,
    1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) p from d
), t as (
  select r, n, i, w[1 + case when i >= a then a + (i - a) % p else i end] x from (select *, unnest(range(n)) i from s)
), pairs as (
  select u.r, v.i - u.i p, u.i, u.n from t u join t v on u.r = v.r and u.x = v.x and v.i > u.i and v.i - u.i <= u.n // 4
), stretches as (
  select r, p, min(i) start, count(*) + p length from (select *, i - row_number() over (partition by r, p order by i) g from pairs) group by r, p, g
  having count(*) + p >= greatest(6, 4 * p)
), runs as (select r, cast(start as bigint) start, cast(length as bigint) length, cast(min(p) as bigint) period from stretches group by r, start, length
), best as (
  select r, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) lines,
    first(struct_pack(start, length, period) order by length desc, start, period) b from runs group by r
), gone as (select distinct r, unnest(range(start + period, start + length)) i from runs
), kept as (select t.r, string_agg(x, ' ' order by t.i) k from t left join gone on t.r = gone.r and t.i = gone.i where gone.r is null group by 1
)
select doc_id, coalesce(n_runs, 0) n_runs, b.start, b.length, b.period, 1000 * b.length // b.period exponent_milli,
  sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(k, '')) collapsed_sha256
from s left join best using (r) left join kept using (r)
"""
