"""Suffix-array dedup: exact repeats of 50 bytes by a hash-compared suffix sort.

(1) Every window of 50 bytes has an anchor, the 24-gram of the least hash in it; equal windows have equal anchors.
Chunks of documents send each bucket their distinct anchors once, and only windows whose anchor occurs twice or
more go on. (2) Runs of such windows with one anchor travel as one snippet of text, to the bucket of the anchor,
each distinct snippet once per chunk. (3) A bucket sorts the suffixes of its snippets: prefix sums of a polynomial
hash and a binary search give two suffixes' common extension, so a comparison in the mergesort takes six probes.
Neighbours that extend over the whole window are one repeat, verified byte by byte, with its smallest document.
(4) Each chunk learns which of its windows a smaller document has, and takes those bytes out.

An anchor of over ``HOT`` places (a passage of very many documents, with as many surroundings) is routed by whole
windows instead: equal ones collapse in their chunk and different ones spread over the buckets. No step pairs
documents, and no group grows with the number of copies beyond one entry per chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BASE_A, BASE_B, chunk_count, chunks, discard, equal_spans, lean_cogroup, lean_group, mix, powers, read_table, rolling, span_hashes, span_keys, spread, written
from millrace.llm.substring import _among, _binary, _ddl, _ids, _inside, _split

WINDOW = 50
GRAM = 24
HOT = 2000
#: Bytes of snippets that a bucket sorts at a time (more only if one anchor has more).
SORT_BYTES = 1 << 19


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of the window at each byte up to the last full one."""
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64)
    return slide_min(rolling(data, GRAM, BASE_A), WINDOW - GRAM + 1)


def _route(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))


def _breaks(keys: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where, among ascending places ``at``, a run of one key in one text and without gaps begins."""
    if not len(at):
        return np.zeros(0, np.int64)
    text = np.searchsorted(offsets, at, side="right")
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (np.diff(at) != 1) | (np.diff(text) != 0)]))


_PROBES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("probes", pa.binary()), ("counts", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hits", pa.binary()), ("hot", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _send_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk, found = table.column("chunk")[0].as_py(), []
        for _, _, data, offsets in chunks(_binary(table.column("text"))):
            at = np.flatnonzero(_inside(offsets, WINDOW))
            keys = anchors(data)[at]
            found.append(_route(keys[_breaks(keys, at, offsets)], buckets))
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        at, low = _split(keys >> np.uint64(32), buckets), keys.astype(np.uint32)
        return _rows([(b, chunk, low[s:e].tobytes(), counts[s:e].tobytes()) for b, (s, e) in enumerate(zip(at[:-1], at[1:])) if s < e], _PROBES)

    return run


def _find_repeats(table: pa.Table) -> pa.Table:
    bucket, chunk = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
    probes = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("probes")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("counts")]).astype(np.int64)
    every = np.concatenate(probes)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    total = np.add.reduceat(counts[order], first)
    keys = every[order][first]
    hits, hot = keys[total > 1], keys[total > HOT]
    rows = []
    for c, p in zip(chunk, probes):
        own = p[_among(p, hits)]
        if len(own):
            rows.append((c, bucket, own.tobytes(), np.packbits(_among(own, hot)).tobytes()))
    return _rows(rows, _ANSWERS)


_MARKED = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_bytes", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("snippets", pa.binary())])


def _mark(buckets: int):
    """Texts with candidate windows are kept with these, as snippets (first window, windows, bucket); the others are done."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _MARKED.empty_table()
        chunk, texts = left.column("chunk")[0].as_py(), _binary(left.column("text"))
        none = np.zeros(0, np.uint64)
        parts = [(np.frombuffer(h.as_py(), np.uint32).astype(np.uint64) | np.uint64(b.as_py() << 32), np.frombuffer(x.as_py(), np.uint8)) for b, h, x in zip(right.column("bucket"), right.column("hits"), right.column("hot"))]
        hits = np.concatenate([none, *(h for h, _ in parts)])
        hot = np.concatenate([np.zeros(0, bool), *(np.unpackbits(x, count=len(h)).astype(bool) for h, x in parts)])
        order = np.argsort(hits)
        hits, hot = hits[order], hot[order]
        sizes, sha, text_out, out = [], [], [], []
        for lo, hi, data, offsets in chunks(texts):
            sizes.append(np.diff(offsets))
            at = np.flatnonzero(_inside(offsets, WINDOW)) if len(hits) else np.zeros(0, np.int64)
            keys = anchors(data)[at]
            first = _breaks(keys, at, offsets)
            routes = _route(keys[first], buckets)
            ok = _among(routes, hits)
            heat = np.zeros(len(first), bool)
            if len(hits):
                heat[ok] = hot[np.searchsorted(hits, routes[ok])]
            count = np.diff(np.append(first, len(at)))
            begin, count, bucket = at[first[ok]], count[ok], (routes[ok] >> np.uint64(32)).astype(np.int64)
            if heat.any():
                begin, count, bucket = _by_window(data, begin, count, bucket, heat[ok], buckets)
            bounds = np.searchsorted(begin, offsets)
            packed = np.stack([begin - np.repeat(offsets[:-1], np.diff(bounds)), count, bucket], axis=1).astype(np.int32)
            raw = data.tobytes()
            for i in range(hi - lo):
                s, e = bounds[i], bounds[i + 1]
                text = raw[offsets[i] : offsets[i + 1]]
                if s < e:
                    sha.append(None)
                    text_out.append(text)
                    out.append(_pack(packed[s:e]))
                else:
                    sha.append(hashlib.sha256(text).hexdigest())
                    text_out.append(None)
                    out.append(None)
        return pa.Table.from_arrays(
            [pa.array(np.full(left.num_rows, chunk, np.int32)), left.column("doc_id"), left.column("th"), pa.array(np.concatenate(sizes)), pa.array(sha, pa.string()), pa.array(text_out, pa.binary()), pa.array(out, pa.binary())], schema=_MARKED
        )

    return run


def _pack(snippets: np.ndarray) -> bytes:
    """Rows (first window, windows, bucket) in planes: the gap to the snippet before, mostly 0, and small numbers."""
    begin, count, bucket = snippets.T
    gap = begin - np.concatenate([[0], (begin + count)[:-1]])
    return b"".join(x.astype(np.uint32).tobytes() for x in (gap, count, bucket))


def _unpack(raw: bytes) -> np.ndarray:
    gap, count, bucket = np.frombuffer(raw, np.uint32).reshape(3, -1).astype(np.int64)
    return np.stack([np.cumsum(gap) + np.cumsum(count) - count, count, bucket])


def _by_window(data: np.ndarray, begin: np.ndarray, count: np.ndarray, bucket: np.ndarray, hot: np.ndarray, buckets: int):
    """Hot snippets cut into their windows, each with the bucket of its own hash."""
    n = np.where(hot, count, 1)
    of = np.repeat(np.arange(len(n)), n)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    own = hot[of]
    to = bucket[of]
    to[own] = (span_hashes(data, at[own], at[own] + WINDOW, BASE_B) >> np.uint64(32)) % np.uint64(buckets)
    return at, np.where(own, 1, count[of]), to


_SNIPPETS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("count", pa.binary()), ("least", pa.binary()), ("multi", pa.binary()), ("text", pa.binary())])


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the spans, end to end."""
    return data[spread(begin, size)]


class Snippets:
    """The snippets of a chunk, and its distinct ones in the order of (bucket, two content hashes): an order that the
    chunk finds again when the answers come, so that these name a snippet by its place in its bucket."""

    def __init__(self, table: pa.Table):
        texts, listed = _binary(table.column("text")), table.column("snippets").combine_chunks()
        ids = _ids(table.column("doc_id"))
        begin, count, bucket, a, b, row, parts, base = [], [], [], [], [], [], [], 0
        for lo, hi, data, offsets in chunks(texts):
            own = [_unpack(listed[i].as_py()) for i in range(lo, hi)]
            at = np.concatenate([x[0] + o for x, o in zip(own, offsets)])
            n = np.concatenate([x[1] for x in own])
            stop = at + n + WINDOW - 1
            begin.append(at + base)
            count.append(n)
            bucket.append(np.concatenate([x[2] for x in own]))
            a.append(span_keys(data, at, stop, BASE_A))
            b.append(span_keys(data, at, stop, BASE_B))
            row.append(np.repeat(np.arange(lo, hi), [x.shape[1] for x in own]))
            parts.append(data)
            base += len(data)
        self.data = np.concatenate(parts)
        self.offsets = np.concatenate([[0], np.cumsum([len(x.as_buffer()) for x in texts])])
        self.begin, self.count, row = (np.concatenate(x) for x in (begin, count, row))
        self.doc = ids[row]
        bucket, a, b = (np.concatenate(x) for x in (bucket, a, b))
        self.order = np.lexsort((self.doc, b, a, bucket))
        x, y, z = bucket[self.order], a[self.order], b[self.order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])])
        at = np.flatnonzero(~new)
        i, j = self.order[at], self.order[at - 1]
        if (self.count[i] != self.count[j]).any() or not equal_spans(self.data, self.begin[i], self.begin[j], self.count[i] + WINDOW - 1).all():
            raise ArithmeticError("two snippets of different text have the same 128 bits of keys: change BASE_A")
        self.first = np.flatnonzero(new)
        self.bucket = x[self.first]

    def groups(self) -> np.ndarray:
        """The number of the distinct snippet that each one is."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.order))))
        return out


def _send_snippets(table: pa.Table) -> pa.Table:
    chunk, s = table.column("chunk")[0].as_py(), Snippets(table)
    pick, last = s.order[s.first], s.order[np.append(s.first[1:], len(s.order)) - 1]
    count, least, multi = s.count[pick], s.doc[pick], s.doc[pick] != s.doc[last]
    edge = np.flatnonzero(np.concatenate([[True], s.bucket[1:] != s.bucket[:-1]]))
    rows = []
    for x, y in zip(edge, np.append(edge[1:], len(pick))):
        text = _gather(s.data, s.begin[pick[x:y]], count[x:y] + WINDOW - 1)
        rows.append((int(s.bucket[x]), chunk, count[x:y].astype(np.uint32).tobytes(), least[x:y].tobytes(), np.packbits(multi[x:y]).tobytes(), text.tobytes()))
    return _rows(rows, _SNIPPETS)


def _distinct(key: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, more: np.ndarray, text: np.ndarray):
    """Order, first of each distinct snippet in it, the smallest doc of each, whether it has several.

    Neighbours are one snippet only if their bytes are the same.
    """
    order = np.lexsort((doc, key))
    x, n, d = key[order], size[order], doc[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (n[1:] != n[:-1])])
    twin = np.flatnonzero(~new)
    new[twin] = ~equal_spans(text, begin[order[twin]], begin[order[twin - 1]], n[twin])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1
    return order, at, d[at], (d[at] != d[last]) | np.maximum.reduceat(more[order], at)


class Suffixes:
    """Windows of a text, compared by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, width: int = WINDOW):
        self.data, self.width = data, width
        up, self.down = powers(BASE_B, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the windows at i and j, by binary search over prefix hashes."""
        out = np.zeros(len(i), np.int64)
        fi, fj, ti, tj = self.down[i], self.down[j], self.total[i], self.total[j]
        step = 1 << (self.width.bit_length() - 1)
        while step:
            reach = out + step
            ok = reach <= self.width
            reach = np.minimum(reach, self.width)
            same = (self.total[i + reach] - ti) * fi == (self.total[j + reach] - tj) * fj
            out += np.where(ok & same, step, 0)
            step >>= 1
        return out

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Suffixes whose windows have one hash are equal; only the others are searched for where they part."""
        out = np.zeros(len(i), bool)
        k = np.flatnonzero(self.whole(i) != self.whole(j))
        i, j = i[k], j[k]
        e = np.minimum(self.extension(i, j), self.width - 1)
        out[k] = self.data[i + e] < self.data[j + e]
        return out

    def whole(self, i: np.ndarray) -> np.ndarray:
        return (self.total[i + self.width] - self.total[i]) * self.down[i]

    def equal(self, i: np.ndarray, j: np.ndarray, part: int = 1 << 16) -> np.ndarray:
        """Verified byte by byte where the hashes agree."""
        out = self.extension(i, j) >= self.width
        at = np.flatnonzero(out)
        reach = np.arange(self.width)
        for lo in range(0, len(at), part):
            some = at[lo : lo + part]
            out[some] = (self.data[i[some, None] + reach] == self.data[j[some, None] + reach]).all(axis=1)
        return out

    def sort(self, places: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort of each group of ``size`` places laid end to end, all groups at once."""
        places = places.copy()
        first = np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        of = np.repeat(size, size)
        width = 1
        while width < (size.max() if len(size) else 0):
            at = np.flatnonzero(of > width)
            begin, n, own = first[at], of[at], at - first[at]
            run = own // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            start, later, x = low.copy(), run & 1 == 1, places[at]
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) // 2
                y = places[begin[k] + middle]
                # a run's element goes before equal ones of the later run
                on = np.where(later[k], ~self.less(x[k], y), self.less(y, x[k]))
                low[k] = np.where(on, middle + 1, low[k])
                high[k] = np.where(on, high[k], middle)
            moved = begin + np.minimum(run * width, other) + (own - run * width) + (low - start)
            places[moved] = x
            width *= 2
        return places


_SOURCES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("place", pa.binary()), ("runs", pa.binary()), ("first", pa.binary()), ("count", pa.binary()), ("least", pa.binary())])


def _heads(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of the first 24 bytes at each place: windows that are equal have equal keys, and few others do."""
    out = np.zeros(len(at), np.uint64)
    for part in range(3):
        head = np.zeros(len(at), np.uint64)
        for k in range(8):
            head = head << np.uint64(8) | text[at + 8 * part + k]
        out = mix(out ^ head)
    return out


def _repeats(text: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray, many: np.ndarray):
    """For windows at ``at``, in groups of ``size`` that have one key: the smallest document of those equal to each, and
    whether these are several. The windows are laid out anew, sorted by suffix, and equal neighbours are verified."""
    data = text[(at[:, None] + np.arange(WINDOW)).ravel()]
    suffixes = Suffixes(data)
    windows = suffixes.sort(np.arange(len(at)) * WINDOW, size) // WINDOW
    group = np.repeat(np.arange(len(size)), size)
    edge = np.ones(len(windows), bool)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    edge[inner] = ~suffixes.equal(windows[inner - 1] * WINDOW, windows[inner] * WINDOW)
    s = np.flatnonzero(edge)
    d, m = doc[windows], many[windows]
    lowest = np.minimum.reduceat(d, s)
    several = np.maximum.reduceat(m, s) | (lowest != np.maximum.reduceat(d, s))
    n = np.diff(np.append(s, len(windows)))
    doc, many = doc.copy(), many.copy()
    doc[windows], many[windows] = np.repeat(lowest, n), np.repeat(several, n)
    return doc, many


def _sort_bucket(table: pa.Table) -> pa.Table:
    bucket, chunk = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
    read = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    count, least, texts = read("count", np.uint32), read("least", np.int64), read("text", np.uint8)
    multi = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("multi"), count)]
    lens = [len(x) for x in count]
    keys = []
    for n, t in zip(count, texts):  # text is all that travels
        end = np.cumsum(n.astype(np.int64) + WINDOW - 1)
        keys.append(span_keys(t, np.concatenate([[0], end[:-1]]), end, BASE_A))
    counts, text = np.concatenate(count).astype(np.int64), np.concatenate(texts)
    begins = np.concatenate([[0], np.cumsum(counts + WINDOW - 1)[:-1]])
    order, at, low, many = _distinct(np.concatenate(keys), begins, counts + WINDOW - 1, np.concatenate(least), np.concatenate(multi), text)
    unique = np.empty(len(counts), np.int64)
    unique[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    pick = order[at]
    run_of, run_first, run_count, run_least = _sorted_runs(counts[pick], begins[pick], low, many, text)
    where = np.searchsorted(run_of, np.arange(len(at) + 1))
    n_runs = np.diff(where)
    rows, base = [], 0
    for c, n in zip(chunk, lens):
        u = unique[base : base + n]
        base += n
        place = np.flatnonzero(n_runs[u] > 0)
        if len(place):
            u = u[place]
            runs = n_runs[u]
            index = np.repeat(where[u] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            rows.append((c, bucket, place.astype(np.uint32).tobytes(), runs.astype(np.uint32).tobytes(), run_first[index].tobytes(), run_count[index].tobytes(), run_least[index].tobytes()))
    return _rows(rows, _SOURCES)


def _alike(text: np.ndarray, at: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which groups hold one window only, over and over: these are sorted as they stand. Their documents are settled here.

    One hash of the whole window tells, and every byte is compared before it is believed.
    """
    whole = np.empty(len(at), np.uint64)
    lo = 0
    while lo < len(at):  # windows of neighbouring snippets stand together in the text
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18))))
        some = at[lo:hi] - at[lo]
        whole[lo:hi] = span_hashes(text[at[lo] : at[hi - 1] + WINDOW], some, some + WINDOW, BASE_B)
        lo = hi
    ordered = whole[order]
    alike = (np.minimum.reduceat(ordered, first) == np.maximum.reduceat(ordered, first)) & (size > 1)
    groups = np.flatnonzero(alike)
    reach, per, g = np.arange(WINDOW), 1 << 16, 0
    up_to = np.cumsum(size[groups])
    while g < len(groups):
        end = max(g + 1, int(np.searchsorted(up_to, (up_to[g - 1] if g else 0) + per, side="right")))
        own = groups[g:end]
        n = size[own]
        windows = order[spread(first[own], n)]
        heads = np.repeat(order[first[own]], n)
        begin = np.cumsum(n) - n
        equal = (text[at[windows, None] + reach] == text[at[heads, None] + reach]).all(axis=1)
        alike[own] = np.minimum.reduceat(equal, begin)
        lowest, highest = np.minimum.reduceat(doc[windows], begin), np.maximum.reduceat(doc[windows], begin)
        now = np.maximum.reduceat(several[windows], begin) | (lowest != highest)
        keep = np.repeat(alike[own], n)
        doc[windows[keep]], several[windows[keep]] = np.repeat(lowest, n)[keep], np.repeat(now, n)[keep]
        g = end
    return alike


def _sorted_runs(counts: np.ndarray, begins: np.ndarray, low: np.ndarray, many: np.ndarray, text: np.ndarray):
    """Runs of windows that several documents have, with one smallest document: (snippet, first, windows, document).

    Windows are ordered by key and taken in slices of whole keys, of about SORT_BYTES bytes of their text each.
    """
    by_text = np.argsort(begins)
    counts, begins, low, many = counts[by_text], begins[by_text], low[by_text], many[by_text]
    of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    inner = (np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)).astype(np.int32)
    at = begins[of] + inner
    key = np.concatenate([_heads(text, at[lo : lo + (1 << 18)]) for lo in range(0, len(at), 1 << 18)])
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    size = np.diff(np.append(first, len(order)))
    doc, several = low[of], many[of]
    mixed = ~_alike(text, at, order, first, size, doc, several) & (size > 1)
    first, size = first[mixed], size[mixed]
    up_to = np.cumsum(size)
    g, most = 0, SORT_BYTES // WINDOW
    while g < len(first):
        end = max(g + 1, int(np.searchsorted(up_to, (up_to[g - 1] if g else 0) + most, side="right")))
        n = size[g:end]
        mine = order[spread(first[g:end], n)]
        doc[mine], several[mine] = _repeats(text, at[mine], n, doc[mine], several[mine])
        g = end
    w = np.flatnonzero(several)
    s = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 1) | (np.diff(of[w]) != 0) | (np.diff(doc[w]) != 0)])) if len(w) else w
    snippet, size = by_text[of[w[s]]], np.diff(np.append(s, len(w)))
    by_snippet = np.argsort(snippet, kind="stable")
    at, size = w[s][by_snippet], size[by_snippet]
    return snippet[by_snippet], inner[at].astype(np.uint32), size.astype(np.uint32), doc[at]


_RESULT = "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT_ARROW.empty_table()
        s = Snippets(left)
        bucket_first = np.searchsorted(s.bucket, np.arange(int(s.bucket[-1]) + 2))
        n_groups = len(s.first)
        runs = np.zeros(n_groups, np.int64)
        found = []
        for bucket, place, n in zip(right.column("bucket").to_pylist(), right.column("place"), right.column("runs")):
            group = np.frombuffer(place.as_py(), np.uint32).astype(np.int64) + bucket_first[bucket]
            runs[group] = np.frombuffer(n.as_py(), np.uint32)
            found.append(group)
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in right.column(name))])
        first, count, least = join("first", np.uint32).astype(np.int64), join("count", np.uint32).astype(np.int64), join("least", np.int64)
        arrived = np.concatenate([np.zeros(0, np.int64), *found])
        begins = np.zeros(n_groups, np.int64)
        begins[arrived] = np.cumsum(runs[arrived]) - runs[arrived]
        group = s.groups()
        n = runs[group]
        each = np.repeat(begins[group] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        earlier = least[each] < np.repeat(s.doc, n)
        start = np.repeat(s.begin, n)[earlier] + first[each[earlier]]
        cover = np.zeros(len(s.data) + 1, np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + count[each[earlier]] + WINDOW - 1, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        fresh = gone.copy()
        fresh[1:] &= ~gone[:-1]
        inner = s.offsets[:-1][s.offsets[:-1] < len(s.data)]
        fresh[inner] = gone[inner]
        removed, spans = np.diff(total[s.offsets]), np.diff(np.concatenate([[0], np.cumsum(fresh)])[s.offsets])
        left_over, stay = s.data[~gone].tobytes(), s.offsets - total[s.offsets]
        sha, kept = [], []
        for b, e, k in zip(stay[:-1].tolist(), stay[1:].tolist(), removed.tolist()):
            text = left_over[b:e]
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text if with_text and k else None)
        return pa.Table.from_arrays([left.column("doc_id"), left.column("th"), left.column("n_bytes"), pa.array(removed), pa.array(spans), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], schema=_RESULT_ARROW)

    return run


def repeated_bytes(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, th (xxhash64 of the text), n_bytes, n_removed, n_spans, kept_sha256, kept (null if whole).

    A byte goes if a string of WINDOW bytes over it also starts in a document with a smaller doc_id; characters may
    be cut. Null and empty texts have no bytes. A null doc_id comes after all others, and one null is not smaller
    than another. Rows of one doc_id never remove each other's bytes; repeated rows fare alike. An empty table
    gives no rows; other columns are ignored. One text must fit in a worker's memory several times over. The result is
    a table in the shared folder; what the steps wrote is removed.
    """
    parts = chunk_count(docs)
    buckets = 2 * parts  # a bucket's windows take more memory than a chunk's texts
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(parts)).cast("int"))
    by_chunk = lambda df: df.repartitionById(parts, F.col("chunk")).groupBy("chunk")
    by_bucket = lambda df: df.repartitionById(buckets, F.col("bucket")).groupBy("bucket")

    sent = by_chunk(keyed.select("chunk", "text")).applyInArrow(lean_group(_send_anchors(buckets)), _ddl(_PROBES))
    answers = written(by_bucket(sent).applyInArrow(lean_group(_find_repeats), _ddl(_ANSWERS)), "suffix-anchors")
    marked = written(by_chunk(keyed).cogroup(by_chunk(answers)).applyInArrow(lean_cogroup(_mark(buckets)), _ddl(_MARKED)), "suffix-marked")
    discard(answers)

    held = marked.where("snippets is not null")
    snippets = by_chunk(held).applyInArrow(lean_group(_send_snippets), _ddl(_SNIPPETS))
    sources = written(by_bucket(snippets).applyInArrow(lean_group(_sort_bucket), _ddl(_SOURCES)), "suffix-sources")
    cut = by_chunk(held).cogroup(by_chunk(sources)).applyInArrow(lean_cogroup(_remove(with_text)), _RESULT)
    zero = F.lit(0).cast("long")
    whole = marked.where("snippets is null").select("doc_id", "th", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    out = written(cut.union(whole), "suffix-result")
    discard(sources)
    discard(marked)
    return out


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(read_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Bytes are written as two hex digits, so that windows are plain strings.
OP8_SQL = """
with d as (select row_number() over () r, doc_id, coalesce(doc_id, 9223372036854775807) id, hex(encode(coalesce(text, ''))) h from documents
), g as (select r, id, i, substr(h, 2 * i + 1, 100) t from (select r, id, h, unnest(range(0, length(h) // 2 - 49)) i from d where length(h) >= 100)
), f as (select t, min(id) least_id from g group by t
), x as (select r, i from g join f using (t) where least_id < id group by r, i
), s as (select r, i, i - lag(i) over (partition by r order by i) > 50 is not false begins from x
), n as (select r, i, count(*) filter (where begins) over (partition by r order by i) run from s
), runs as (select r, min(i) a, max(i) + 50 b from n group by r, run
), gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) z from runs
), k as (
  select r, sum(b - a) n_removed, count(*) n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) kept
  from gaps join d using (r) group by r
)
select doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256
from d left join k using (r)
"""
