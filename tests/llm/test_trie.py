"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest
from llm import cases

from millrace.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + t[h:]
    return out


def trie(sequences):
    members = {}
    for c, t in sequences.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) if p in kids else 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p))))))
        for p, m in members.items()
    )


def rows_of(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


def made(seed, conversations, most=14, words=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["é" * k for k in range(words)])) for c in conversations for t in range(rng.randrange(0, most))]


ODD = [
    *made(1, range(-12, 40)), *made(2, range(100, 140), words=1),
    (200, None, None, None), (200, None, "user", "x"), (200, 1, "user", None), (200, 1, "user", ""), (200, 1, "user", ""), (201, 0, "us", "erx"), (202, 0, "user", "x"),
    (None, 0, "user", "lost"), (None, None, None, None), (10**15, 5, "user", "y"),
]


def test_query_and_sql(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).withColumns({x: F.lit(7) for x in ("node", "parent", "at", "n", "depth", "symbol", "bytes", "length", "base", "h", "own", "digest", "number")})
    folder = cases.saved(df.repartition(3), tmp_path, "conversations")
    found = rows_of(pt.op13_prefix_trie(spark, folder))
    assert found == trie(rebuilt(ODD))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet/*.parquet')")
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in db.sql(pt.OP13_SQL).fetchall()) == found


def test_blocks_of_few_turns(spark):
    """Classes that go on over several blocks, and chains that leave them at their end."""
    rng = random.Random(4)
    trunk = [("r", str(k)) for k in range(23)]
    sequences = {c: (trunk[: rng.randrange(0, 24)] + [("r", f"{c % 3}{k}") for k in range(rng.randrange(0, 9))]) for c in range(30)}
    sequences |= {50: trunk, 51: trunk, 52: list(trunk), 53: []}
    turns = spark.createDataFrame([(c, d + 1, bytes(f"{r}|{x}", "ascii"), len(x)) for c, t in sequences.items() for d, (r, x) in enumerate(t)], "conv_id long, depth long, symbol binary, bytes long")
    lengths = spark.createDataFrame([(c, len(t)) for c, t in sequences.items()], "conv_id long, length long")
    assert rows_of(pt.prefix_trie(turns, lengths, 2, 5)) == trie(sequences)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(3, 0, "user", "x")], [(5, 0, "user", "x"), (7, 0, "user", "x")]])
def test_few_conversations(spark, tmp_path, rows):
    folder = cases.saved(spark.createDataFrame(rows, SCHEMA), tmp_path, "conversations")
    assert rows_of(pt.op13_prefix_trie(spark, folder)) == (trie(rebuilt(rows)) if rebuilt(rows) else [])


def test_many_members_end_at_a_node(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 7)
    members = spark.range(1000).selectExpr("cast(case when id % 3 = 0 then 'a' else 'b' end as binary) node", "id conv_id")
    found = {bytes(r["node"]): r["ends"] for r in pt._ends(members).collect()}
    assert found == {k: sha(",".join(str(i) for i in range(1000) if (i % 3 == 0) == (k == b"a"))) for k in (b"a", b"b")}
