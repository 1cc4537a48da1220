"""Operators against brute-force versions on whole small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from llm import cases
from tokenizers import Tokenizer

from millrace.llm import decontaminate, language, packing, queries, rules, simhash, substring, suffix
from millrace.llm.common import rolling, span_hashes, words

DATA = "/root/testdata/sf0.001"
SPACE = b" \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with passages of every length around the limits, in several places and orders."""
    rng = np.random.default_rng(5)
    rows, shared = [], [f"w{k}" for k in range(160)]
    for k in range(60):
        own = [f"d{k}x{j}" for j in range(int(rng.integers(0, 60)))]
        a, n = int(rng.integers(0, 100)), int(rng.integers(5, 60))
        at = int(rng.integers(0, len(own) + 1))
        rows.append((int(k), " ".join(own[:at] + shared[a : a + n] + own[at:] + (own[:30] if k % 5 == 0 else [])), "en", "s", 1))
    rows += [(100 + k, "é" * 40 + "ab" * k + "ß" * 30, "de", "s", 1) for k in range(6)]
    rows += [(200, "x " * 400, "en", "s", 1), (201, "y" + "x " * 300, "en", "s", 1), (202, "z" * 49, "en", "s", 1), (203, "z" * 50, "en", "s", 1), (204, "q" + "z" * 49, "en", "s", 1)]
    rows += [(None, rows[3][1], "en", "s", 1), (None, rows[3][1] + " tail", "en", "s", 1), (3, rows[4][1], "en", "s", 1)]
    return cases.saved(cases.table(spark, rows), tmp_path_factory.mktemp("odd")), rows


def removed(items, width):
    """items: (id or None, sequence). Which places each loses."""
    last = float("inf")
    first = {}
    for i, s in items:
        for p in range(len(s) - width + 1):
            w = tuple(s[p : p + width]) if isinstance(s, list) else s[p : p + width]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, s in items:
        gone = [False] * len(s)
        for p in range(len(s) - width + 1):
            w = tuple(s[p : p + width]) if isinstance(s, list) else s[p : p + width]
            if first[w] < (last if i is None else i):
                gone[p : p + width] = [True] * width
        out.append(gone)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op10(spark, odd):
    folder, rows = odd
    items = [(i, t.encode().split()) for i, t, *_ in rows]
    wanted = Counter((i, len(s), sum(g), sha(b" ".join(w for w, x in zip(s, g) if not x))) for (i, s), g in zip(items, removed(items, 50)))
    found = substring.op10_substring_dedup(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == wanted


@pytest.mark.parametrize("hot", [2, 2000])
def test_op8(spark, odd, hot, monkeypatch):
    folder, rows = odd
    monkeypatch.setattr(suffix, "HOT", hot)
    items = [(i, t.encode()) for i, t, *_ in rows]
    wanted = Counter()
    for (i, s), g in zip(items, removed(items, 50)):
        spans = sum(x and not y for x, y in zip(g, [False, *g]))
        wanted[(i, len(s), sum(g), spans, sha(bytes(c for c, x in zip(s, g) if not x)))] += 1
    found = suffix.op8_suffix_dedup(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == wanted


def test_suffix_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1200] = data[2000:2200]
    s = suffix.Suffixes(data)
    places, size = rng.permutation(2900)[:900], np.array([1, 400, 499])
    found, raw, at = s.sort(places, size), data.tobytes(), 0
    for n in size:
        ordered = [raw[p : p + 50] for p in found[at : at + n]]
        assert ordered == sorted(raw[p : p + 50] for p in places[at : at + n])
        at += n
    i, j = found[:-1], found[1:]
    common = [next((k for k in range(50) if raw[a + k] != raw[b + k]), 50) for a, b in zip(i, j)]
    assert s.extension(i, j).tolist() == common and s.equal(i, j).tolist() == [c == 50 for c in common]


def test_op7(spark, odd, documents):
    folder, rows = odd
    for source, texts in ((folder, [(i, t) for i, t, *_ in rows]), (DATA, list(documents.items()))):
        fps = [simhash.fingerprint(t.encode()) for _, t in texts]
        parent = list(range(len(fps)))

        def find(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    parent[find(a)] = find(b)
        least = defaultdict(list)
        for k, (i, _) in enumerate(texts):
            if i is not None:
                least[find(k)].append(i)
        wanted = Counter((i, f"{f:016x}", min(least[find(k)], default=None)) for k, ((i, _), f) in enumerate(zip(texts, fps)))
        found = simhash.op7_simhash_dedup(spark, source).collect()
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == wanted


def test_fingerprint_by_hand():
    import xxhash

    text = "A b\tc d  E f g"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(4)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.fingerprint(b"Two words") == xxhash.xxh64_intdigest("two words", 42) and simhash.fingerprint(None) == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.int64)
    y = x.copy()
    for k in range(4):
        y ^= np.int64(1) << rng.integers(0, 63, 3000)
    (kx, rx), (ky, ry) = simhash.keys_of(x), simhash.keys_of(y)
    both = {*zip(kx.tolist(), rx.tolist())} & {*zip(ky.tolist(), ry.tolist())}
    assert {r for _, r in both} == set(range(3000))


def test_hot_buckets_lose_no_link(spark):
    """A ball of near fingerprints, with buckets and blocks so small that all are dealt out anew."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (120, 2))} | {base})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from millrace.llm.components import components

    found = components(simhash.near_links(df, bucket_rows=8, block_rows=4)).collect()
    assert {r["root"] for r in found} == {min(fps)} and len(found) == len(fps)


def test_components_of_a_chain(spark):
    from millrace.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_op6(spark):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    wanted = sorted(db.sql(f"select {', '.join(names)} from ({queries.SQL['op6_decontamination']})").fetchall())
    found = sorted(tuple(r[n] for n in names) for r in decontaminate.op6_decontamination(spark, DATA).collect())
    assert found == wanted and any(r[-1] for r in found)


def test_op6_small_windows(spark):
    docs = cases.table(spark, [(1, "A b, c D e! a b c", None, None, 1), (2, "b a", None, None, 1), (3, "É é x", None, None, 1)])
    items = spark.createDataFrame([(10, "a B c"), (9, "b a"), (8, "É"), (7, "zz a b"), (6, "a")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.hits(docs, items).collect()}
    assert found == {1: (6, 2, sha(b"10,6")), 2: (2, 2, sha(b"6,9")), 3: (1, 1, sha(b"8"))}


def test_proximity(spark):
    docs = cases.table(spark, [(1, "red big old house", None, None, 1), (2, "red house far away old", None, None, 1), (3, "house", None, None, 1)])
    items = spark.createDataFrame([(5, "red old house"), (6, "house")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["place"]) for r in decontaminate.proximity(docs, items, 1).collect())
    # the rarest word of "red old house" is its first: red (2 places) before old (2, later in the phrase) and house (3)
    assert found == [(1, 5, 0), (1, 6, 3), (2, 6, 1), (3, 6, 0)]


def test_op3(spark, odd):
    folder, rows = odd
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = cases.table(spark, [*[r for r in rows if r[0] is not None and r[0] != 3], (900, "<|EndOfText|> <|endoftext|>x DON'T é. İ ΣΑΣ. 12,5", "en", "s", 1), (901, None, "en", "s", 1), (902, cases.LONG, "en", "s", 1)])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = defaultdict(list)
    sequences = Counter()
    for r in packing.pack(docs).collect():
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]] += r["length"]
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0
    assert max(sequences.values()) <= 2048 and set(by) == set(texts)
    for i, pieces in by.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids"]) == (at, len(ids), piece)
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_cut():
    assert packing.cut(5) == [(0, 4), (4, 1)] and packing.cut(4096 + 3) == [(0, 2048), (2048, 2048), (4096, 2), (4098, 1)] and packing.cut(0) == []


def test_word_cache_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    encode, plain = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(12):
        t = cases.text(k) + " End. " + cases.text(1)
        assert encode(t.encode()).tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_suffix_dedup", "op10_substring_dedup"])
def test_queries_agree_with_their_sql(spark, odd, name):
    for folder in (odd[0], DATA):
        db = duckdb.connect()
        path = Path(folder) / "documents.parquet"
        db.sql(f"create view documents as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        wanted = db.sql(queries.SQL[name])
        found = Counter(tuple(r) for r in queries.QUERIES[name](spark, str(folder)).select(*wanted.columns).collect())
        assert found == Counter(wanted.fetchall())


def test_op2_counts(spark, odd, documents):
    folder, rows = odd
    for source, texts in ((folder, [(i, t) for i, t, *_ in rows]), (DATA, list(documents.items()))):
        wanted = Counter()
        for i, t in texts:
            w = regex.findall(r"[^\x20\x09-\x0D]+", t)
            seen, dups = set(), 0
            for line in t.split("\n"):
                if regex.search(r"[^\x20\x09-\x0D]", line):
                    dups += line in seen
                    seen.add(line)
            n = Counter(zip(w, w[1:], w[2:]))
            hit = {k + d for k in range(len(w) - 2) for d in range(3) if n[tuple(w[k : k + 3])] > 1}
            wanted[(i, len(w), sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", t)), dups, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
        found = rules.op2_quality_rules(spark, source).collect()
        assert Counter(tuple(r)[:7] for r in found) == wanted
        assert not any(r["kept"] and r["base_failed"] for r in found)


def test_words_and_hashes():
    texts = [b"", b" a  bb\tc ", b"\n", "é ü".encode(), b"last"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = words(data, offsets)
    assert [data[s:e].tobytes() for s, e in zip(starts, ends)] == [w for t in texts for w in t.split()]
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]
    at = np.arange(len(data) - 2)
    assert (rolling(data, 3) == span_hashes(data, at, at + 3, 0xD6E8FEB86659FD93)).all()


def test_op4(spark, documents):
    found = language.op4_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = found[found["held_out"]]
    assert set(held["doc_id"]) == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held["lang_pred"] == held["doc_id"].map(truth)).mean() > 0.98 and found["score"].between(0, 1).all()


def test_op4_counts_by_hand():
    texts = ["Ab, é", "", "12"]
    raw = [t.encode() for t in texts]
    grams, bounds, has = language.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert has.tolist() == [True, False, False]
    # letters: a b é; pairs with a letter: " a", "ab", "b ", " é", "é "; triples around a letter: " ab", "ab ", " é "
    assert [np.diff(b).tolist() for b in bounds] == [[3, 0, 0], [5, 0, 0], [3, 0, 0]]
