"""Periodic runs against a scan of every period, on made sequences and on the contract's own texts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from llm import cases

from millrace.llm import periodic

DATA = "/root/testdata/sf0.001"


def scanned(w):
    names = {x: k for k, x in enumerate(w)}
    w, found = np.array([names[x] for x in w], np.int64), {}
    for p in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], w[:-p] == w[p:], [0]]).astype(np.int8)
        for start, end in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if end + p - start >= max(6, 4 * p):
                found.setdefault((start, end + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def wanted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = scanned(w)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def in_order(rows):
    return sorted(rows, key=repr)


def made(rng, letters):
    w = []
    for _ in range(rng.randrange(0, 6)):
        if rng.random() < 0.5:
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            w += (unit * 9)[: rng.randrange(1, 9 * len(unit))]
        else:
            w += [rng.randrange(letters) for _ in range(rng.randrange(0, 30))]
    return w


@pytest.mark.parametrize("pairs", [3, 50, 1 << 19])
def test_runs_of_made_sequences(pairs, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(150):
        docs = [made(rng, rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(1, 6))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        found = zip(*(x.tolist() for x in periodic.runs_of(np.array([x for d in docs for x in d], np.int64), first)))
        assert list(found) == [(s + first[k], s + size + first[k], p) for k, d in enumerate(docs) for s, size, p in scanned(d)]


def test_hashes_that_lie_are_found_out(monkeypatch):
    class Careless(periodic.Prefixes):
        def agree(self, a, p, n):
            return super().agree(a, p, n) if self.careful else np.ones(len(a), bool)

        def __init__(self, values, longest, seed):
            self.careful = seed > 1
            super().__init__(values, longest, seed)

    monkeypatch.setattr(periodic, "Prefixes", Careless)
    w = [0, 1, 0, 1, 0, 1, 0, 1, 2, 3, 3, 3, 3, 3, 3, 3, 0]
    assert [x.tolist() for x in periodic.runs_of(np.array(w), np.array([0, len(w)]))] == [[0, 9], [8, 16], [2, 1]]


def test_long_texts():
    n = 200_000
    one = periodic.runs_of(np.zeros(n, np.int64), np.array([0, n]))
    assert [x.tolist() for x in one] == [[0], [n], [1]]
    tiled = periodic.runs_of(np.tile(np.arange(n // 5), 5), np.array([0, n]))
    assert [x.tolist() for x in tiled] == [[0], [n], [n // 5]]


def test_query_against_a_scan(spark):
    found = periodic.op12_periodic_runs(spark, DATA).collect()
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert in_order(map(tuple, found)) == in_order(wanted(r["doc_id"], r["text"]) for r in rows)


ROWS = [
    *cases.ROWS,
    *[(k, t, "en", "s", 1) for k in range(40, 60) for t in (" ".join("ab"[j % 2] for j in range(k)), "ä\tö\n" * (k - 38) + " ende", "x " * 7 + "y")],
    (70, "a a a a a", "en", "s", 1), (71, "a a a a a a", "en", "s", 1), (72, "a b a b a b a", "en", "s", 1), (73, "a b a b a b a b", "en", "s", 1),
]


def test_odd_texts_and_sql(spark, tmp_path):
    folder = cases.saved(cases.clashing(spark, ROWS), tmp_path)
    found = in_order(map(tuple, periodic.op12_periodic_runs(spark, folder).collect()))
    assert found == in_order(wanted(i, t) for i, t, *_ in ROWS)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    assert in_order(db.sql(periodic.OP12_SQL).fetchall()) == found


def test_operator_keeps_the_texts(spark):
    docs = cases.table(spark, [(1, "so so so so so so it goes", "en", "s", 1), (2, None, "en", "s", 1)])
    found = {r["id"]: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(x) for x in found["1"]["runs"]] == [(0, 6, 1)] and bytes(found["1"]["collapsed"]) == b"so it goes" and found["1"]["n_words"] == 8
    assert found["2"]["runs"] == [] and bytes(found["2"]["collapsed"]) == b"" and found["2"]["n_words"] == 0
    assert periodic.periodic_runs(cases.table(spark, [])).count() == 0
