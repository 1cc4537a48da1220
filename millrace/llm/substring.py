"""Substring dedup by fixed-block anchors.

A window of 50 words that starts in two documents covers, in either, a whole block of 25 words at a multiple of 25.
So: (1) every document's non-overlapping blocks are indexed and every rolling 25-word window of every document
probes that index; (2) windows of 50 words around a hit are the only candidates, and those found in another
document (96 bits of two independent keys) extend the hits: consecutive ones with one source, the smallest document
that has them, chain to the maximal repeat; (3) each chunk fetches the texts of its sources, every repeat is compared
with its source word for word, and the words it covers go.

How it moves: documents are dealt into chunks by a hash of id and text, as many as keep a chunk's text in CHUNK_BYTES.
A chunk sends, per hash bucket, one sorted array of its distinct keys, so a passage that a third of all documents
share is one entry per chunk, never a group; a bucket answers each chunk with one array. The two folds therefore hold
(chunks + entries) and no pairs. Probes are compared on 32 bits and a bucket number, where a false hit only makes a
candidate. A chunk fetches a source once, however many of its documents repeat it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BASE_A, BASE_B, STEP_A, STEP_B, chunk_count, chunks, discard, lean, lean_cogroup, lean_group, read_table, rolling, word_hashes, words, written

WINDOW = 50
BLOCK = 25
#: A null doc_id comes after all others.
LAST = np.iinfo(np.int64).max


def _binary(col) -> pa.LargeBinaryArray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.cast(pa.large_binary())


def _ids(col) -> np.ndarray:
    return col.combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _inside(first: np.ndarray, width: int) -> np.ndarray:
    """Of the rolling windows over concatenated texts, those that lie in one text."""
    n = int(first[-1])
    ok = np.zeros(max(0, n - width + 1), dtype=bool)
    lens = np.diff(first)
    for_each = np.maximum(lens - width + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(for_each)[:-1]]), for_each) + np.arange(for_each.sum())
    ok[at] = True
    return ok


def _probe_keys(hashes: np.ndarray, buckets: int, block: int) -> np.ndarray:
    """Bucket number and 32 further bits of each rolling window's hash."""
    h = rolling(hashes, block)
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _split(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _send_probes(buckets: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        probes, blocks = [], []
        for _, _, data, offsets in chunks(_binary(table.column("text"))):
            starts, ends, first = words(data, offsets)
            if len(starts) < block:
                continue
            keys = _probe_keys(word_hashes(data, starts, ends), buckets, block)
            inside = _inside(first, block)
            probes.append(keys[inside])
            index = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))[: len(keys)]
            blocks.append(keys[inside & (index % block == 0)])
        if not probes:
            return _PROBES.empty_table()
        keys, counts = np.unique(np.concatenate(probes), return_counts=True)
        anchors = np.unique(np.concatenate(blocks))
        at, at_anchor = _split(keys >> np.uint64(32), buckets), _split(anchors >> np.uint64(32), buckets)
        low, low_anchor, multi = keys.astype(np.uint32), anchors.astype(np.uint32), counts > 1
        rows = [(b, chunk, low[at[b] : at[b + 1]].tobytes(), np.packbits(multi[at[b] : at[b + 1]]).tobytes(), low_anchor[at_anchor[b] : at_anchor[b + 1]].tobytes()) for b in range(buckets) if at[b] < at[b + 1]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PROBES)], schema=_PROBES)

    return run


_PROBES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("probes", pa.binary()), ("multi", pa.binary()), ("blocks", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hits", pa.binary())])


def _find_hits(table: pa.Table) -> pa.Table:
    """Of each chunk's probes in this bucket, those that hit an indexed block and occur twice or more."""
    bucket, chunk = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
    probes = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("probes")]
    multi = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("multi"), probes)]
    anchors = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("blocks")]))
    every = np.sort(np.concatenate([np.concatenate([p, p[m]]) for p, m in zip(probes, multi)]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    hits = twice[_among(twice, anchors)]
    found = [p[_among(p, hits)] for p in probes]
    keep = [i for i, x in enumerate(found) if len(x)]
    return pa.Table.from_arrays([pa.array([chunk[i] for i in keep], pa.int32()), pa.array([bucket] * len(keep), pa.int32()), pa.array([found[i].tobytes() for i in keep], pa.binary())], schema=_ANSWERS)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


_MARKED = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("starts", pa.binary())])


def _mark(buckets: int, block: int, window: int):
    """Documents with candidate windows keep their words, joined by spaces, and candidate starts; the others are done."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _MARKED.empty_table()
        chunk, texts = left.column("chunk")[0].as_py(), _binary(left.column("text"))
        hits = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h.as_py(), np.uint32).astype(np.uint64) | np.uint64(b.as_py() << 32) for b, h in zip(right.column("bucket"), right.column("hits")))]))
        n_words, sha, text_out, starts_out = [], [], [], []
        for lo, hi, data, offsets in chunks(texts):
            starts, ends, first = words(data, offsets)
            counts = np.diff(first)
            n_words.append(counts)
            reach = window - block
            candidates = np.zeros(0, bool)
            if len(hits) and len(starts) >= window:
                keys = _probe_keys(word_hashes(data, starts, ends), buckets, block)
                hit = _inside(first, block)
                hit[hit] = _among(keys[hit], hits)
                total = np.concatenate([[0], np.cumsum(hit)])
                candidates = total[reach + 1 :] > total[: -(reach + 1)]
                candidates &= _inside(first, window)
            at = np.flatnonzero(candidates)
            bounds = np.searchsorted(at, first)
            raw = data.tobytes()
            for i in range(hi - lo):
                mine = at[bounds[i] : bounds[i + 1]] - first[i]
                text = raw[offsets[i] : offsets[i + 1]]
                if len(mine):
                    sha.append(None)
                    text_out.append(b" ".join(text.split()))
                    starts_out.append(_runs(mine).tobytes())
                else:
                    sha.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    text_out.append(None)
                    starts_out.append(None)
        return pa.Table.from_arrays(
            [pa.array(np.full(left.num_rows, chunk, np.int32)), left.column("doc_id"), left.column("th"), pa.array(np.concatenate(n_words)), pa.array(sha, pa.string()), pa.array(text_out, pa.binary()), pa.array(starts_out, pa.binary())], schema=_MARKED
        )

    return run


def _runs(at: np.ndarray) -> np.ndarray:
    """Ascending integers as (first, last + 1) of their runs, int32."""
    edge = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])] + 1], axis=1).astype(np.int32).ravel()


def _candidates(table: pa.Table, window: int):
    """For a part of the texts at a time: both hashes of the candidate windows, their rows and start words, with the words' bytes."""
    starts_col = table.column("starts").combine_chunks()
    for lo, hi, data, offsets in chunks(_binary(table.column("text"))):
        starts, ends, first = words(data, offsets)
        runs = [np.frombuffer(starts_col[i].as_py(), np.int32).reshape(-1, 2) + first[i - lo] for i in range(lo, hi)]
        row = np.repeat(np.arange(lo, hi), [(r[:, 1] - r[:, 0]).sum() for r in runs])
        both = np.concatenate(runs)
        size = both[:, 1] - both[:, 0]
        at = np.repeat(both[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        a = rolling(word_hashes(data, starts, ends, BASE_A), window, STEP_A)[at]
        b = rolling(word_hashes(data, starts, ends, BASE_B), window, STEP_B)[at]
        yield a, b, row, at, first, lo, data, starts, ends


_WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("least", pa.binary()), ("part", pa.binary()), ("multi", pa.binary())])
_SOURCES = pa.schema([("chunk", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("least", pa.binary()), ("part", pa.binary())])


def _parts(col) -> np.ndarray:
    """The low half of each text's hash: with the doc_id it names a row, should rows share an id."""
    return col.combine_chunks().to_numpy().astype(np.uint32)


def _fold(a: np.ndarray, b: np.ndarray, doc: np.ndarray, part: np.ndarray, more: np.ndarray | None = None):
    """Distinct (a, b) in order, with the smallest doc of each and its part, and whether it has several docs (or ``more`` says so)."""
    order = np.lexsort((part, doc, b, a))
    a, b, doc, part = a[order], b[order], doc[order], part[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(a)) - 1
    multi = doc[at] != doc[last]
    if more is not None:
        multi |= np.maximum.reduceat(more[order], at)
    return a[at], b[at], doc[at], part[at], multi


def _send_windows(buckets: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        chunk, ids, th = table.column("chunk")[0].as_py(), _ids(table.column("doc_id")), _parts(table.column("th"))
        found = [(a, (b >> np.uint64(32)).astype(np.uint32), ids[row], th[row]) for a, b, row, *_ in _candidates(table, window)]
        a, b, least, part, multi = _fold(*(np.concatenate(x) for x in zip(*found)))
        bucket = a % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        at = _split(bucket[order], buckets)
        a, b, least, part, multi = a[order], b[order], least[order], part[order], multi[order]
        rows = [(k, chunk, a[s:e].tobytes(), b[s:e].tobytes(), least[s:e].tobytes(), part[s:e].tobytes(), np.packbits(multi[s:e]).tobytes()) for k, (s, e) in enumerate(zip(at[:-1], at[1:])) if s < e]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOWS)], schema=_WINDOWS)

    return run


def _find_sources(table: pa.Table) -> pa.Table:
    """For each chunk, its windows that several documents have, with the smallest of those."""
    chunk = table.column("chunk").to_pylist()
    read = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    a, b, least, part = read("a", np.uint64), read("b", np.uint32), read("least", np.int64), read("part", np.uint32)
    multi = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("multi"), a)]
    ka, kb, first, own, many = _fold(*(np.concatenate(x) for x in (a, b, least, part, multi)))
    ka, kb, first, own = ka[many], kb[many], first[many], own[many]
    rows = []
    for c, x, y in zip(chunk, a, b):
        at, ok = _lookup(ka, kb, x, y)
        if ok.any():
            rows.append((c, x[ok].tobytes(), y[ok].tobytes(), first[at[ok]].tobytes(), own[at[ok]].tobytes()))
    if not rows:
        return _SOURCES.empty_table()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SOURCES)], schema=_SOURCES)


def _lookup(ka: np.ndarray, kb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where (a, b) stands in the ordered (ka, kb), and whether it does."""
    if not len(ka):
        return np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(ka, a), len(ka) - 1)
    while (short := (ka[at] == a) & (kb[at] < b) & (at + 1 < len(ka)) & (ka[np.minimum(at + 1, len(ka) - 1)] == a)).any():
        at = at + short  # equal first hashes are all but unheard of
    return at, (ka[at] == a) & (kb[at] == b)


_RESULT = "doc_id long, th long, n_words long, n_removed long, kept_sha256 string, kept binary"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_REPEATS = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("text", pa.binary()), ("start", pa.binary()), ("windows", pa.binary()), ("source", pa.binary()), ("part", pa.binary())])


def _find_repeats(window: int):
    """Each document's repeats: first window, windows, and the smallest document that has the same words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _REPEATS.empty_table()
        ids = _ids(left.column("doc_id"))
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in right.column(name))])
        ka, kb, least, parts = join("a", np.uint64), join("b", np.uint32), join("least", np.int64), join("part", np.uint32)
        order = np.lexsort((kb, ka))
        ka, kb, least, parts = ka[order], kb[order], least[order], parts[order]
        found: list[tuple[bytes, ...]] = []
        for a, b, row, at, first, lo, *_ in _candidates(left, window):
            where, ok = _lookup(ka, kb, a, (b >> np.uint64(32)).astype(np.uint32))
            if len(least):
                ok &= least[where] < ids[row]
            at, row, where = at[ok], row[ok], where[ok]
            source, part = (least[where], parts[where].astype(np.int64)) if len(least) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0) | (np.diff(source) != 0) | (np.diff(part) != 0)])) if len(at) else at
            size = np.diff(np.append(edge, len(at)))
            bounds = np.searchsorted(row[edge], np.arange(lo, lo + len(first)))
            for i in range(len(first) - 1):
                mine = slice(bounds[i], bounds[i + 1])
                found.append(((at[edge[mine]] - first[i]).astype(np.int64).tobytes(), size[mine].astype(np.int64).tobytes(), source[edge[mine]].tobytes(), part[edge[mine]].tobytes()))
        cols = [pa.array(c, pa.binary()) for c in zip(*found)]
        return pa.Table.from_arrays([left.column("chunk"), left.column("doc_id"), left.column("th"), left.column("n_words"), left.column("text").cast(pa.binary()), *cols], schema=_REPEATS)

    return run


def _same_words(own: bytes, starts: list[int], ends: list[int], first: int, windows: int, sources: list[bytes], window: int) -> list[tuple[int, int]]:
    """The parts (first window, windows) of a repeat that one of the sources has word for word."""
    inside = lambda k, n: any(b" " + own[starts[k] : ends[k + n + window - 2]] + b" " in s for s in sources)
    if inside(first, windows):
        return [(first, windows)]
    return [(k, 1) for k in range(first, first + windows) if inside(k, 1)]  # its windows stand apart in the source


def _remove(window: int, with_text: bool):
    """Takes out the words of those repeats that their source has, compared word for word."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT_ARROW.empty_table()
        sources: dict[tuple[int, int], list[bytes]] = {}
        for *i, text in zip(right.column("source").to_pylist(), right.column("part").to_pylist(), right.column("text")):
            sources.setdefault(tuple(i), []).append(b" " + text.as_py() + b" ")
        texts, lists = _binary(left.column("text")), [left.column(c).combine_chunks() for c in ("start", "windows", "source", "part")]
        removed, sha, kept = [], [], []
        for lo, hi, data, offsets in chunks(texts):
            starts, ends, first = words(data, offsets)
            cover = np.zeros(len(starts) + 1, np.int64)
            raw, s, e = data.tobytes(), starts.tolist(), ends.tolist()
            for i in range(lo, hi):
                for k, n, *source in zip(*(np.frombuffer(x[i].as_py(), np.int64).tolist() for x in lists)):
                    for at, m in _same_words(raw, s, e, int(first[i - lo]) + k, n, sources.get(tuple(source), []), window):
                        cover[at] += 1
                        cover[at + m + window - 1] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            for i in range(hi - lo):
                stay = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                left_over = b" ".join([raw[s[k] : e[k]] for k in stay.tolist()])
                n = int(total[first[i + 1]] - total[first[i]])
                removed.append(n)
                sha.append(hashlib.sha256(left_over).hexdigest())
                kept.append(left_over if with_text and n else None)
        return pa.Table.from_arrays([left.column("doc_id"), left.column("th"), left.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], schema=_RESULT_ARROW)

    return run


def _wanted(batches):
    """(chunk, source, part) of the repeats, each once per batch."""
    for batch in batches:
        read = lambda k: [np.frombuffer(x.as_py(), np.int64) for x in batch.column(k)]  # noqa: B023, E731
        source, part = read(1), read(2)
        chunk = np.repeat(batch.column(0).to_numpy().astype(np.int64), [len(x) for x in source])
        rows = np.unique(np.stack([chunk, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (source, part))]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1]), pa.array(rows[2])], ["chunk", "source", "part"])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def repeated_passages(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, th (xxhash64 of the text), n_words, n_removed, kept_sha256, kept (null if whole).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller doc_id. Null and
    empty texts have no words and keep all of them. A null doc_id comes after all others, and one null is not
    smaller than another. Rows of one doc_id never remove each other's words; repeated rows fare alike. An empty
    table gives no rows; other columns are ignored. One text must fit in a worker's memory several times over. The
    result is a table in the shared folder; what the steps wrote is removed.
    """
    block, parts = window // 2, chunk_count(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(parts)).cast("int"))
    by_chunk = lambda df: df.repartitionById(parts, F.col("chunk")).groupBy("chunk")
    by_bucket = lambda df: df.repartitionById(parts, F.col("bucket")).groupBy("bucket")

    sent = by_chunk(keyed.select("chunk", "text")).applyInArrow(lean_group(_send_probes(parts, block)), _ddl(_PROBES))
    answers = written(by_bucket(sent).applyInArrow(lean_group(_find_hits), _ddl(_ANSWERS)), "substring-hits")
    marked = written(by_chunk(keyed).cogroup(by_chunk(answers)).applyInArrow(lean_cogroup(_mark(parts, block, window)), _ddl(_MARKED)), "substring-marked")
    discard(answers)

    held = marked.where("starts is not null")
    windows = by_chunk(held).applyInArrow(lean_group(_send_windows(parts, window)), _ddl(_WINDOWS))
    sources = written(by_bucket(windows).applyInArrow(lean_group(_find_sources), _ddl(_SOURCES)), "substring-sources")
    repeats = written(by_chunk(held).cogroup(by_chunk(sources)).applyInArrow(lean_cogroup(_find_repeats(window)), _ddl(_REPEATS)), "substring-repeats")
    discard(sources)
    wanted = repeats.select("chunk", "source", "part").mapInArrow(lean(_wanted), "chunk int, source long, part long").distinct()
    texts = held.select(F.col("doc_id").alias("source"), F.col("th").bitwiseAND(F.lit(0xFFFFFFFF)).alias("part"), "text").dropDuplicates(["source", "part", "text"])
    fetched = texts.join(wanted, ["source", "part"]).select("chunk", "source", "part", "text")
    cut = by_chunk(repeats).cogroup(by_chunk(fetched)).applyInArrow(lean_cogroup(_remove(window, with_text)), _RESULT)
    whole = marked.where("starts is null").select("doc_id", "th", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    out = written(cut.union(whole), "substring-result")
    discard(repeats)
    discard(marked)
    return out


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(read_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a document of which nothing is left goes.

    A text that loses words becomes its other words, joined by one space; the others stay as they are.
    """
    found = repeated_passages(docs)
    changed = found.where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("kept").cast("string").alias("__kept")).distinct()
    joined = docs.withColumn("__own_th", F.xxhash64("text")).join(changed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own_th") == F.col("__th")), "left")
    new = {"text": F.coalesce("__kept", "text"), "n_chars": F.when(F.col("__kept").isNotNull(), F.length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    return joined.where("__kept is null or __kept <> ''").select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


OP10_SQL = r"""
with d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents
), p as (select r, doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50
), g as (select r, coalesce(doc_id, 9223372036854775807) id, i, array_to_string(list_slice(w, i, i + 49), ' ') t from p
), f as (select t, min(id) least_id from g group by t
), x as (select distinct r, unnest(range(i, i + 50)) q from g join f using (t) where least_id < id
), words as (select r, unnest(w) word, unnest(range(1, len(w) + 1)) q from d
), a as (
  select words.r, count(x.q) n_removed, string_agg(word, ' ' order by words.q) filter (where x.q is null) kept
  from words left join x on words.r = x.r and words.q = x.q group by 1
)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join a using (r)
"""
