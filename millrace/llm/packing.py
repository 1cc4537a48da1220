"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are the binary digits of its id count (2048 as often as it
fits), longest first. A piece is a whole sequence of a power-of-two length, so nothing is padded and no sequence
crosses documents; equal lengths share a bucket, from which batches of one length are drawn. Pieces depend on
their own document only: the operator needs no shuffle and no state besides a bounded word cache.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import lean, read_table, text_column

END_ID = 1
SEQUENCE = 2048
#: Words and stems of a generation that a worker remembers, over all its tasks; those used since pass to the next.
CACHE_WORDS = 250_000
#: ASCII marks that the tokenizer never joins to a letter or digit before them (an apostrophe it may).
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int, ids array<int>"


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    return Tokenizer.from_file(path)


class WordEncoder:
    """ids of whole texts, word by word: the tokenizer drops white space and no token spans it.

    A word is encoded once and remembered; one that ends in marks is its stem's ids and its marks' ids.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = _tokenizer(path), {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters alone are one unit each to the tokenizer: they go joined, and the ids that end a word part them."""
        known, single, odd = self.known, [], []
        for w in words:
            t = w.decode("utf-8", "replace")
            (single if (t.isalpha() if t.isascii() else unicodedata.normalize("NFC", t.lower()).isalpha()) else odd).append((w, t))
        for lo in range(0, len(single), 256):
            some = single[lo : lo + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some):
                raw, at = ids.tobytes(), 0
                for (w, _), e in zip(some, (stop * 4).tolist()):
                    known[w] = raw[at:e]
                    at = e
            else:
                odd += some
        for lo in range(0, len(odd), 512):
            some = odd[lo : lo + 512]
            for (w, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        known, parts, cut_at = self.known, set(), []
        for w in new:
            stem = w.rstrip(MARKS)
            if 0 < len(stem) < len(w) and stem[-1:].isalnum() and b"<|" not in w:
                cut_at.append((w, len(stem)))
                parts.add(stem)
                parts.add(w[len(stem) :])
            else:
                parts.add(w)
        older = self.older
        known.update((w, older[w]) for w in parts if w in older and w not in known)
        self._encode([w for w in parts if w not in known])
        for w, at in cut_at:
            known[w] = known[w[:at]] + known[w[at:]]

    def __call__(self, text: bytes) -> np.ndarray:
        parts = (text if b"<|" in text else text.lower()).split()  # the tokenizer folds case, but not of its special tokens
        found = list(map(self.known.get, parts))
        if None in found:
            new = {w for w, x in zip(parts, found) if x is None}
            if len(self.known) + 2 * len(new) > CACHE_WORDS:
                self.older, self.known = self.known, {}
                new = set(parts)
            self.known.update((w, self.older[w]) for w in new if w in self.older)
            self._learn([w for w in new if w not in self.known])
            found = map(self.known.__getitem__, parts)
        return np.frombuffer(b"".join(found), dtype="<u4")


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: ``most`` as often as it fits, then the binary digits of the rest."""
    pieces, at = [], 0
    while n - at >= most:
        pieces.append((at, most))
        at += most
    for bit in range(most.bit_length() - 2, -1, -1):
        if (n - at) >> bit & 1:
            pieces.append((at, 1 << bit))
            at += 1 << bit
    return pieces


def _pack(path: str, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            text = text_column(batch, "text")
            ids_of = batch.column(batch.schema.get_field_index("doc_id"))
            rows: list[tuple] = []
            row_of: list[int] = []
            held = 0
            for i in range(len(text)):
                raw = text[i].as_py()
                ids = np.append(encode(raw) if raw else np.zeros(0, "<u4"), np.uint32(END_ID)).astype("<u4")
                for start, length in cut(len(ids), most):
                    piece = ids[start : start + length]
                    rows.append((start, length, zlib.crc32(piece.tobytes()), len(ids), 0, length.bit_length() - 1, piece if with_ids else None))
                    row_of.append(i)
                held += len(ids)
                if held > 2_000_000:
                    yield _out(ids_of, row_of, rows, with_ids)
                    rows, row_of, held = [], [], 0
            if rows:
                yield _out(ids_of, row_of, rows, with_ids)

    return run


def _out(ids_of, row_of, rows, with_ids) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [ids_of.take(pa.array(row_of, pa.int64())).cast(pa.int64())]
    arrays += [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.int32())]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "bucket"]
    if with_ids:
        arrays.append(pa.array([c.astype(np.int32) for c in cols[6]], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, offset, bucket, sequence_id and the ids.

    Null and empty texts give one piece, the end id alone. A null doc_id stays null. Repeated rows are packed each
    on their own. Other columns are ignored. An empty table gives no rows. ``most`` must be a power of two.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = SCHEMA if with_ids else SCHEMA.rpartition(", ids")[0]
    pieces = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(_pack(path, most, with_ids)), schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"
    )
