"""LM scoring by a gated recurrent language model in numpy.

Words are factored as class, entry within the class and, for the entry that stands for a class's rarer words, the
word's share of their counts: P(word | h) = P(class | h) P(entry | class, h) share(word). Classes are ranges of
spelling from the word's end, of about equal training mass, so every word has one, seen or not.

Counts cover all training documents. The network starts from the unigram model and is trained on every token of
every training document, in rounds that grow fourfold. A round's documents are dealt by a hash into shards of about
``SHARD_TOKENS``; each shard runs truncated backpropagation from the same parameters, in the order of the hash, and
the shards' parameters and step sizes are averaged by their tokens. Shards follow from the data alone, so the model
does not depend on how the table is partitioned. Scoring carries the state from window to window through each whole
document. Only the commonest ``COMMON`` words are broadcast; the counts of the others are joined in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BASE_B, ascii_lower, chunks, crc_mod, discard, lean, read_table, text_column, word_hashes, words, written

CLASSES, ENTRIES, HIDDEN = 48, 48, 16
#: The end of a text: a class of its own, entry 0, a hash that stands for no word and no suffix.
END_HASH = np.uint64(0x0E5D0E5D0E5D0E5D)
TAIL = ENTRIES - 1
TAG_BITS = 7
#: Words whose class, entry and count every worker has (20 bytes each).
COMMON = 1 << 17
#: Parts, in hundredths of a hash, of the training documents that the rounds take: each document is in one round.
ROUNDS = ((0, 2), (2, 8), (8, 32), (32, 100))
#: Tokens of a shard, and the most tasks that shards are dealt to.
SHARD_TOKENS, MOST_TASKS = 2_000_000, 20_000
#: Streams trained side by side, and steps of a window.
STREAMS, WINDOW = 512, 24
RATE = 0.12
#: Tokens that a worker holds at a time.
HELD_TOKENS = 1_500_000
NEVER = np.float32(-1e9)
#: Logits start as log-probabilities and are bounded by this, so no softmax needs its maximum taken off.
MOST_LOGIT = np.float32(60)
ONES = {n: np.ones(n, np.float32) for n in (CLASSES + 1, ENTRIES)}


def suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last three bytes of each word, last first."""
    out = data[ends - 1].astype(np.int32) << 16
    for k, shift in ((2, 8), (3, 0)):
        there = ends - k >= starts
        out |= np.where(there, data[np.maximum(ends - k, 0)], 0).astype(np.int32) << shift
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tag (-1 at the end) of each text's tokens, and where each text's begin.

    A word is known by 95 bits: a 64-bit hash and a tag of its suffix and seven bits of a second hash.
    """
    data = ascii_lower(data)
    starts, ends, first = words(data, offsets)
    begin = first + np.arange(len(first))
    hashes = np.full(begin[-1], END_HASH)
    tag = np.full(begin[-1], -1, dtype=np.int32)
    at = np.arange(len(starts)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
    second = word_hashes(data, starts, ends, BASE_B) >> np.uint64(64 - TAG_BITS)
    hashes[at], tag[at] = word_hashes(data, starts, ends), suffixes(data, starts, ends) << TAG_BITS | second.astype(np.int32)
    return hashes, tag, begin


def _summed(hashes: np.ndarray, tag: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with their counts; words of one hash may stand in several rows."""
    order = np.argsort(hashes)
    h, t = hashes[order], tag[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
    return h[at], t[at], np.diff(np.append(at, len(h))) if n is None else np.add.reduceat(n[order], at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def done():
        h, t, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t), pa.array(n)], ["hash", "tag", "n"])

    for batch in batches:
        for _, _, data, offsets in chunks(text_column(batch, "text")):
            hashes, tag, _ = tokens(data, offsets)
            if not len(hashes):
                continue
            held.append(_summed(hashes, tag))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield done()
                held, size = [], 0
    if held:
        yield done()


@dataclass
class Vocabulary:
    """The bounded part of the vocabulary that every worker has."""

    hashes: np.ndarray  # sorted, of the COMMON commonest
    tag: np.ndarray
    count: np.ndarray
    code: np.ndarray  # class * ENTRIES + entry
    bounds: np.ndarray  # suffixes at which the classes after the first begin
    class_mass: np.ndarray
    entry_mass: np.ndarray  # classes x entries; 0 where there is none
    tail_mass: np.ndarray
    total: int
    distinct: int

    def look_up(self, hashes: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each token, and its count or -1 if it is not among the common ones."""
        code = self.class_of(tag >> TAG_BITS) * ENTRIES + TAIL
        if not len(self.hashes):
            return code.astype(np.int32), np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = (self.hashes[at] == hashes) & (self.tag[at] == tag)
        return np.where(known, self.code[at], code).astype(np.int32), np.where(known, self.count[at], -1)

    def class_of(self, suffix: np.ndarray) -> np.ndarray:
        return np.where(suffix < 0, CLASSES, np.searchsorted(self.bounds, suffix, side="right"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (hash, tag, n) of all training tokens. What reaches the driver is bounded: COMMON words, and the mass of
    each pair of last bytes (65 536), between which classes are cut."""
    row = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(row[0] or 0), int(row[1])
    pair = F.shiftright("tag", TAG_BITS + 8)
    by_pair = counts.where("tag >= 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    code, mass = by_pair["pair"].to_numpy().astype(np.int64), by_pair["n"].to_numpy().astype(np.int64)
    up_to = np.cumsum(mass)
    cuts = np.searchsorted(up_to, np.arange(1, CLASSES) * (up_to[-1] / CLASSES)) if len(code) else np.zeros(0, np.int64)
    bounds = np.unique(code[np.minimum(cuts + 1, len(code) - 1)]) << 8 if len(code) else code
    top = counts.orderBy(F.desc("n"), "hash", "tag").limit(COMMON).toArrow()
    hashes, tag, n = top["hash"].to_numpy().view(np.uint64), top["tag"].to_numpy(), top["n"].to_numpy()
    own = Vocabulary(hashes, tag, n, n, bounds, None, None, None, total, distinct)
    cls = own.class_of(tag >> TAG_BITS)
    order = np.lexsort((hashes, -n, cls))
    rank = np.empty(len(n), np.int64)
    first = np.searchsorted(cls[order], np.arange(CLASSES + 2))
    rank[order] = np.arange(len(n)) - np.repeat(first[:-1], np.diff(first))
    entry = np.where(cls == CLASSES, 0, np.minimum(rank, TAIL))
    entry_mass = np.zeros((CLASSES + 1, ENTRIES))
    head = (entry < TAIL) | (cls == CLASSES)
    entry_mass[cls[head], entry[head]] = n[head] + 0.5
    spans = F.when(F.col("tag") < 0, CLASSES)
    for k, b in enumerate(bounds.tolist()):
        spans = spans.when(F.shiftright("tag", TAG_BITS) < b, k)
    per_class = counts.groupBy(spans.otherwise(len(bounds)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    tail_mass = np.full(CLASSES + 1, 0.5)
    tail_mass[CLASSES] = 0.0
    for c, m, types in zip(*(per_class[k].to_pylist() for k in ("c", "n", "types"))):
        if c < CLASSES:
            tail_mass[c] = m + 0.5 * types + 0.5 - entry_mass[c, :TAIL].sum()
    entry_mass[:CLASSES, TAIL] = tail_mass[:CLASSES]
    entry_mass[CLASSES, 0] = max(entry_mass[CLASSES, 0], 0.5)
    by_hash = np.lexsort((tag, hashes))
    return Vocabulary(hashes[by_hash], tag[by_hash], n[by_hash], (cls * ENTRIES + entry)[by_hash], bounds, entry_mass.sum(axis=1), entry_mass, tail_mass, total, distinct)


class Network:
    """X: input rows (code -> 3 gates); R: recurrence; C, c: classes; U, u: entries of each class."""

    SHAPES = {
        "X": ((CLASSES + 1) * ENTRIES, 3 * HIDDEN),
        "R": (HIDDEN, 3 * HIDDEN),
        "C": (HIDDEN, CLASSES + 1),
        "c": (CLASSES + 1,),
        "U": (CLASSES + 1, HIDDEN, ENTRIES),
        "u": (CLASSES + 1, ENTRIES),
    }

    def __init__(self, values: dict[str, np.ndarray]):
        self.__dict__.update(values)

    @classmethod
    def start(cls, v: Vocabulary, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda name, scale: (rng.standard_normal(cls.SHAPES[name]) * scale).astype(np.float32)
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-30)), NEVER).astype(np.float32)
        return cls({"X": draw("X", 0.3), "R": draw("R", 0.25), "C": draw("C", 0.05), "c": log(v.class_mass / max(v.class_mass.sum(), 1e-30)), "U": draw("U", 0.05), "u": log(v.entry_mass / np.maximum(v.class_mass, 1e-30)[:, None])})

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> "Network":
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape).copy()
            at += n
        return cls(out)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.SHAPES])

    def step(self, code: np.ndarray, h: np.ndarray):
        a, r = self.X[code], h @ self.R
        gates = a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(np.minimum(gates, 30, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        inner = r[:, 2 * HIDDEN :]
        new = np.tanh(a[:, 2 * HIDDEN :] + reset * inner)
        return new + z * (h - new), z, reset, new, inner

    def log_softmax(self, h: np.ndarray, target: np.ndarray, part: int = 4096) -> np.ndarray:
        """Natural log-probability of each target code after each state."""
        cls, entry = target // ENTRIES, target % ENTRIES
        out = np.empty(len(h), np.float32)
        for lo in range(0, len(h), part):
            logits = h[lo : lo + part] @ self.C
            logits += self.c
            np.minimum(logits, MOST_LOGIT, out=logits)
            own = logits[np.arange(len(logits)), cls[lo : lo + part]]
            np.exp(logits, out=logits)
            out[lo : lo + part] = own - np.log(logits @ ONES[CLASSES + 1])
        order = np.argsort(cls.astype(np.int8), kind="stable")
        at = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for k, (s, e) in enumerate(zip(at[:-1], at[1:])):
            if s < e:
                mine = order[s:e]
                inner = h[mine] @ self.U[k]
                inner += self.u[k]
                np.minimum(inner, MOST_LOGIT, out=inner)
                own = inner[np.arange(e - s), entry[mine]]
                np.exp(inner, out=inner)
                out[mine] += own - np.log(inner @ ONES[ENTRIES])
        return out


class Trainer:
    """Adagrad over truncated windows."""

    def __init__(self, net: Network, sums: Network | None = None, rate: float = RATE):
        self.net, self.rate = net, rate
        self.sums = {name: np.full(shape, 1e-4, np.float32) if sums is None else getattr(sums, name) for name, shape in Network.SHAPES.items()}

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> "Trainer":
        """From parameters and, after them, the sums of squares that set the step sizes."""
        half = len(flat) // 2
        return cls(Network.from_flat(flat[:half]), Network.from_flat(flat[half:]))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.net.flat(), *(self.sums[name].ravel() for name in Network.SHAPES)])

    def update(self, name: str, grad: np.ndarray, rows=None) -> None:
        value, sums = getattr(self.net, name), self.sums[name]
        if rows is None:
            sums += grad * grad
            value -= self.rate * grad / np.sqrt(sums)
        else:
            s = sums[rows] + grad * grad
            sums[rows] = s
            value[rows] -= self.rate * grad / np.sqrt(s)

    def window(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        """inputs, targets, fresh: steps x streams; fresh marks a text's first token. Returns the last state."""
        net, (steps, streams) = self.net, inputs.shape
        before, states, kept = [], np.empty((steps, streams, HIDDEN), np.float32), []
        for t in range(steps):
            h = h * ~fresh[t][:, None]
            before.append(h)
            h, *rest = net.step(inputs[t], h)
            states[t] = h
            kept.append(rest)
        grad_h = self.outputs(states.reshape(-1, HIDDEN), targets.ravel()).reshape(states.shape)
        grad_in = np.empty((steps, streams, 3 * HIDDEN), np.float32)
        grad_r = np.zeros_like(net.R)
        ahead = np.zeros((streams, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            z, reset, new, inner = kept[t]
            g = grad_h[t] + ahead
            d_new = g * (1 - z) * (1 - new * new)
            d = grad_in[t]
            d[:, :HIDDEN] = g * (before[t] - new) * z * (1 - z)
            d[:, HIDDEN : 2 * HIDDEN] = d_new * inner * reset * (1 - reset)
            d[:, 2 * HIDDEN :] = d_new
            through = d.copy()
            through[:, 2 * HIDDEN :] *= reset
            grad_r += before[t].T @ through
            ahead = (through @ net.R.T + g * z) * ~fresh[t][:, None]
        code = inputs.ravel()
        order = np.argsort(code.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
        rows = np.add.reduceat(grad_in.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        scale = np.float32(1 / streams)
        self.update("X", np.clip(rows * scale, -1, 1), code[order][first])
        self.update("R", np.clip(grad_r * scale, -1, 1))
        return h

    def outputs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Updates the output layers and returns the gradient at the states."""
        net, n = self.net, len(h)
        cls, entry = target // ENTRIES, target % ENTRIES
        p = h @ net.C
        p += net.c
        np.minimum(p, MOST_LOGIT, out=p)
        np.exp(p, out=p)
        p /= (p @ ONES[CLASSES + 1])[:, None]
        p[np.arange(n), cls] -= 1
        grad = p @ net.C.T
        scale = np.float32(1 / n)
        order = np.argsort(cls.astype(np.int8), kind="stable")
        at = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        seen, grad_u, grad_b = [], [], []
        for k, (s, e) in enumerate(zip(at, np.append(at[1:], n))):
            if s == e or k == CLASSES:
                continue
            mine = order[s:e]
            hk = h[mine]
            q = hk @ net.U[k]
            q += net.u[k]
            np.minimum(q, MOST_LOGIT, out=q)
            np.exp(q, out=q)
            q /= (q @ ONES[ENTRIES])[:, None]
            q[np.arange(e - s), entry[mine]] -= 1
            grad[mine] += q @ net.U[k].T
            seen.append(k)
            grad_u.append(hk.T @ q)
            grad_b.append(q.sum(axis=0))
        self.update("C", h.T @ p * scale)
        self.update("c", p.sum(axis=0) * scale)
        if seen:
            self.update("U", np.stack(grad_u) * scale, np.array(seen))
            self.update("u", np.stack(grad_b) * scale, np.array(seen))
        return grad

    def train(self, code: np.ndarray, begin: np.ndarray) -> None:
        """One pass over texts laid end to end, cut into streams; the state goes on from window to window."""
        n = len(code)
        if not n:
            return
        streams = int(np.clip(n // (40 * WINDOW), 1, STREAMS))
        length = -(-n // streams)
        pad = streams * length
        end = CLASSES * ENTRIES
        before = np.concatenate([[end], code[:-1]])
        fresh = np.zeros(n, bool)
        fresh[begin[:-1][begin[:-1] < n]] = True
        lay = lambda x, fill: np.concatenate([x, np.full(pad - n, fill, x.dtype)]).reshape(streams, length).T
        inputs, targets, fresh = lay(before, end), lay(code, end), lay(fresh, True)
        h = np.zeros((streams, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            h = self.window(np.ascontiguousarray(inputs[t : t + WINDOW]), np.ascontiguousarray(targets[t : t + WINDOW]), np.ascontiguousarray(fresh[t : t + WINDOW]), h)


def score(net: Network, code: np.ndarray, begin: np.ndarray, window: int = 64) -> np.ndarray:
    """Natural log-probability of each whole text's codes. Texts are laid into streams, longest first."""
    texts = len(begin) - 1
    out = np.zeros(texts)
    lens = np.diff(begin)
    streams = int(np.clip(begin[-1] // 256, 1, STREAMS // 2))
    lanes, heap = [[] for _ in range(streams)], [(0, k) for k in range(streams)]
    for i in np.argsort(-lens, kind="stable").tolist():
        if lens[i]:
            load, k = heapq.heappop(heap)
            lanes[k].append(i)
            heapq.heappush(heap, (load + int(lens[i]), k))
    lanes = sorted((x for x in lanes if x), key=lambda x: -int(lens[x].sum()))
    if not lanes:
        return out
    size = np.array([int(lens[x].sum()) for x in lanes])
    end = CLASSES * ENTRIES
    length = int(size[0])
    inputs = np.full((len(lanes), length), end, np.int32)
    targets = np.full((len(lanes), length), end, np.int32)
    fresh = np.zeros((len(lanes), length), bool)
    text = np.zeros((len(lanes), length), np.int32)
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            m = int(lens[i])
            own = code[begin[i] : begin[i] + m]
            targets[k, at : at + m] = own
            inputs[k, at + 1 : at + m] = own[:-1]
            fresh[k, at] = True
            text[k, at : at + m] = i
            at += m
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    for t in range(0, length, window):
        some_h, some_target, some_text = [], [], []
        for s in range(t, min(t + window, length)):
            live = int(np.searchsorted(-size, -s, side="left"))
            if not live:
                break
            h = h[:live] * ~fresh[:live, s][:, None]
            h = net.step(inputs[:live, s], h)[0]
            some_h.append(h)
            some_target.append(targets[:live, s])
            some_text.append(text[:live, s])
        if not some_h:
            break
        found = net.log_softmax(np.concatenate(some_h), np.concatenate(some_target))
        out += np.bincount(np.concatenate(some_text), weights=found, minlength=texts)
    return out


def _read(batches: Iterator[pa.RecordBatch], v: Vocabulary, keep: tuple[str, ...] = ()):
    """(columns to keep, code, begin, count, hash) of texts, for parts of about HELD_TOKENS tokens over all batches."""
    held, cols, size = [], [], 0
    for batch in batches:
        for lo, hi, data, offsets in chunks(text_column(batch, "text")):
            hashes, tag, begin = tokens(data, offsets)
            code, count = v.look_up(hashes, tag)
            held.append((code, begin, count, hashes, tag))
            cols.append([batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep])
            size += len(code)
            if size > HELD_TOKENS:
                yield _joined(held, cols)
                held, cols, size = [], [], 0
    if held:
        yield _joined(held, cols)


def _joined(held, cols):
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b, *_ in held]))])
    code, _, count, hashes, tag = (np.concatenate(x) for x in zip(*held))
    return [pa.concat_arrays(c) for c in zip(*cols)], code, begin, count, hashes, tag


PARTS = 32


def _shards(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, code, begin) of rows sorted by shard, in pieces of HELD_TOKENS that end with a text: where they end does
    not depend on the batches."""
    now, held = None, []

    def piece(texts):
        return now, np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])

    for batch in batches:
        shard = batch.column(0).to_numpy()
        for lo, hi, data, offsets in chunks(text_column(batch, "text")):
            hashes, tag, begin = tokens(data, offsets)
            code = v.look_up(hashes, tag)[0]
            for i in range(lo, hi):
                if shard[i] != now:
                    if held:
                        yield piece(held)
                    now, held, size = shard[i], [], 0
                held.append(code[begin[i - lo] : begin[i - lo + 1]])
                size += len(held[-1])
                if size >= HELD_TOKENS:
                    yield piece(held)
                    held, size = [], 0
    if held:
        yield piece(held)


def _train_task(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = sent.value
        now, trainer, n = None, None, 0

        def done():
            for k, piece in enumerate(np.array_split(trainer.flat(), PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["part", "shard", "n", "value"])

        for shard, code, begin in _shards(batches, v):
            if shard != now:
                if trainer:
                    yield from done()
                now, trainer, n = int(shard), Trainer.from_flat(flat), 0
            trainer.train(code, begin)
            n += len(code)
        if trainer:
            yield from done()

    return run


#: Shards whose parameters one task adds up; more are added up in several levels.
FAN_IN = 256


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of FAN_IN shards each, of rows sorted by part and shard: one row at a time."""
    now, n, total = None, 0, 0.0

    def done():
        cols = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["part", "shard", "n", "value"])

    for batch in batches:
        for part, shard, m, value in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            if (part, shard // FAN_IN) != now:
                if now:
                    yield done()
                now, n, total = (part, shard // FAN_IN), 0, 0.0
            n += m
            total = total + m * np.frombuffer(value.as_py(), np.float32).astype(np.float64)
    if now:
        yield done()


def _round(docs: DataFrame, v: Vocabulary, flat: np.ndarray, low: int, high: int) -> np.ndarray:
    """Parameters after the round of the documents whose hash is in [low, high) hundredths."""
    shards = max(1, -(-v.total * (high - low) // (100 * SHARD_TOKENS)))
    h = F.xxhash64("doc_id", "text")
    chosen = docs.withColumn("h", h).where((F.pmod("h", F.lit(100)) >= low) & (F.pmod("h", F.lit(100)) < high))
    # other bits of the hash than the round's
    dealt = chosen.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "text")
    tasks = min(shards, MOST_TASKS)
    ordered = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "h").select("shard", "text")
    sent = docs.sparkSession.sparkContext.broadcast((v, flat))
    kind = "part int, shard long, n long, value binary"
    means = ordered.mapInArrow(lean(_train_task(sent)), kind)
    while True:
        means = means.repartition("part", F.floor(F.col("shard") / FAN_IN)).sortWithinPartitions("part", "shard").mapInArrow(lean(_average), kind)
        if shards <= FAN_IN:
            break
        shards = -(-shards // FAN_IN)
    found = written(means, "gru-parameters")
    pieces = [np.frombuffer(r["value"], np.float32) for r in found.orderBy("part").collect()]  # PARTS rows
    discard(found)
    return np.concatenate(pieces) if pieces else flat


def train(docs: DataFrame) -> tuple[Vocabulary, Network, DataFrame]:
    """Vocabulary and network of all rows of ``docs`` (doc_id, text as binary), and the table of all counts."""
    counts = written(docs.select("text").mapInArrow(lean(_count), "hash long, tag int, n long").groupBy("hash", "tag").agg(F.sum("n").alias("n")), "gru-counts")
    v = vocabulary(counts)
    flat = Trainer(Network.start(v)).flat()
    for low, high in ROUNDS:
        flat = _round(docs, v, flat, low, high)
    return v, Trainer.from_flat(flat).net, counts


_SCORED = "kind int, key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, hash long, tag int"


def _score_task(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = sent.value
        net, key = Network.from_flat(flat), TaskContext.get().partitionId() << 36
        whole = np.log10(v.total + 0.5 * (v.distinct + 1))
        log_tail = np.log10(np.maximum(v.tail_mass, 1e-300))
        for kept, code, begin, count, hashes, tag in _read(batches, v, ("doc_id", "held_out")):
            texts = len(begin) - 1
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[begin])  # noqa: B023, E731
            rare = count < 0
            log_count = np.log10(np.maximum(count, 0) + 0.5)
            log_count[rare] = 0
            n = np.diff(begin)
            tails = (code % ENTRIES == TAIL) & (code < CLASSES * ENTRIES)
            share = np.where(tails, log_count - log_tail[code // ENTRIES], 0.0)
            model = score(net, code, begin) / np.log(10) + sums(share)
            keys = key + np.arange(texts)
            key += texts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(texts, np.int32)), pa.array(keys), *kept, pa.array(n),
                    pa.array(sums(count > 0)), pa.array(sums(log_count) - n * whole), pa.array(model), pa.nulls(texts, pa.int64()), pa.nulls(texts, pa.int32()),
                ],
                _NAMES,
            )
            m = int(rare.sum())
            of = np.repeat(keys, n)[rare]
            for lo in range(0, m, 1 << 18):
                some = slice(lo, min(m, lo + (1 << 18)))
                k = some.stop - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(k, np.int32)), pa.array(of[some]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(hashes[rare][some].view(np.int64)), pa.array(tag[rare][some])],
                    _NAMES,
                )

    return run


_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def score_documents(docs: DataFrame, held_out=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows where ``held_out`` (crc32 of the id modulo 5 is 1, unless given) is false. A null text is
    empty: its one token is the end. Null ids count as the empty text for the fold. Repeated rows are trained on
    and scored each. Without training rows every word is unknown. An empty table gives no rows; other columns are
    ignored. Training and scoring of one text are sequential.
    """
    fold = crc_mod(5) == 1 if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    v, net, counts = train(rows.where("not held_out").select("doc_id", "text"))
    sent = docs.sparkSession.sparkContext.broadcast((v, net.flat()))
    scored = written(rows.mapInArrow(lean(_score_task(sent)), _SCORED), "gru-scores")
    rare = scored.where("kind = 1").select("key", "hash", "tag").join(counts, ["hash", "tag"], "left")
    n = F.coalesce("n", F.lit(0))
    more = rare.groupBy("key").agg(F.sum(F.log10(n + 0.5)).alias("log_counts"), F.count(F.when(n > 0, 1)).alias("known"))
    joined = scored.where("kind = 0").join(more, "key", "left")
    extra = F.coalesce("log_counts", F.lit(0.0))
    out = written(joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score")
    ), "gru-result")
    discard(scored)
    discard(counts)
    return out


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
