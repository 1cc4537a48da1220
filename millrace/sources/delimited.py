"""Delimited text of unknown shape: the delimiter, the header line and the encoding are found in the first lines."""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.blockfile import file_system, paced

DELIMITERS = ",|\t;"
LOOK_LINES = 10
SAMPLE_BYTES = 1 << 16
#: Bytes of a file that a task reads.
SPLIT_BYTES = 32 << 20


@dataclass(frozen=True)
class Shape:
    delimiter: str
    header: tuple[str, ...]
    before: int
    encoding: str


def encoding_of(sample: bytes) -> str:
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    return next((name for mark, name in marks if sample.startswith(mark)), "utf-8")


def records(text: str) -> list[str]:
    """Lines, where a line break within quotes does not end one."""
    out, now, quoted = [], [], False
    for line in text.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        now.append(line)
        quoted ^= line.count('"') % 2 == 1
        if not quoted:
            out.append("\n".join(now))
            now = []
    return out + (["\n".join(now)] if now else [])


def sniff(sample: bytes) -> Shape:
    """Of the first lines (blank ones and comments aside), the first with the most fields and the fewest empty ones
    is the header; its most frequent delimiter is the file's."""
    encoding = encoding_of(sample)
    lines, looked = records(sample.decode(encoding, "replace")), []
    for i, line in enumerate(lines):
        if len(looked) == LOOK_LINES:
            break
        if not line.strip():
            continue
        counts = Counter(c for c in line if c in DELIMITERS)
        delimiter = max(DELIMITERS, key=lambda c: (counts[c], -DELIMITERS.index(c))) if counts else ","
        fields = next(csv.reader(io.StringIO(line), delimiter=delimiter))
        if len(fields) == 1 and "#" in line:
            continue
        looked.append((i, delimiter, fields))
    if not looked:
        return Shape(",", (), 0, encoding)
    most, fewest = max(len(f) for _, _, f in looked), min(sum(not x.strip() for x in f) for _, _, f in looked)
    chosen = next((x for x in looked if len(x[2]) == most and sum(not v.strip() for v in x[2]) == fewest), next(x for x in looked if len(x[2]) == most))
    names, seen = [], Counter()
    for k, n in enumerate(chosen[2]):
        n = n.strip() or f"column_{k}"
        seen[n] += 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return Shape(chosen[1], tuple(names), chosen[0], encoding)


def read_delimited(spark: SparkSession, path: str, most: int = SPLIT_BYTES) -> DataFrame:
    """All columns as text, parsed by Spark (quotes, doubled quotes, quoted line breaks); blank lines are no rows.

    The header and the lines before it are dropped by their place in each file. A file is read by several tasks, ``most``
    bytes each (more if the input is large: ``paced``), although a line break may lie in quotes: see ``_read_spans``. Files whose lines are not ended by LF bytes
    (UTF-16, lone CR) and those in a file system that Arrow does not know are read whole, a file per task.
    """
    listed = sorted((r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())  # a row per file
    try:
        with file_system(listed[0][0])[0].open_input_file(file_system(listed[0][0])[1]) as f:
            sample, known = f.read(SAMPLE_BYTES), True
    except ValueError:
        sample, known = bytes(spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, SAMPLE_BYTES)).first()[0]), False
    shape = sniff(sample)
    if not shape.header:
        return spark.createDataFrame([], "column_0 string")
    skip = sum(bool(x.strip()) for x in records(sample.decode(shape.encoding, "replace"))[: shape.before + 1])  # blank lines are no rows
    if known and shape.encoding != "utf-16" and b"\n" in sample:
        return _read_spans(spark, listed, shape, skip, most)
    return _read_whole(spark, path, shape, skip)


def _schema(shape: Shape) -> str:
    return ", ".join(f"`{n}` string" for n in shape.header)


def _read_whole(spark: SparkSession, path: str, shape: Shape, skip: int) -> DataFrame:
    """A file with quoted line breaks is one split, whose rows are numbered in order."""
    rows = (
        spark.read.option("sep", shape.delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", shape.encoding.removesuffix("-sig"))
        .schema(_schema(shape)).csv(path)
    )
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    first = placed.groupBy("__file").agg(F.min("__at").alias("__first")).withColumnRenamed("__file", "__of")  # a row per file
    met = placed.join(first, F.col("__file") == F.col("__of")).where(F.col("__at") - F.col("__first") >= skip)
    return met.select(*[F.col(f"`{n}`") for n in shape.header])


def quoted_stretches(data: bytes, inside: bool, delimiter: str) -> tuple[list[int], list[int], bool]:
    """Starts and ends of the quoted stretches of ``data``, which begins ``inside`` one or at a record, and whether the last is open."""
    starts, ends, at = [], [], 0
    if inside:
        found = _REST.match(data)
        starts.append(0)
        ends.append(found.end())
        if not found[1]:
            return starts, ends, True
        at = found.end()
    for found in re.compile(rb'(?<![^\r\n%b])"%b' % (re.escape(delimiter.encode()), _REST.pattern)).finditer(data, at):
        starts.append(found.start())
        ends.append(found.end())
        if not found[1]:
            return starts, ends, True
    return starts, ends, False


#: The rest of a quoted stretch, to its closing quote or to the end.
_REST = re.compile(rb'[^"]*(?:""[^"]*)*("?)')


def record_ends(data: bytes, inside: bool, delimiter: str) -> tuple[np.ndarray, bool]:
    """The places after the line breaks that end records, and whether ``data`` ends within quotes."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    starts, ends, still = quoted_stretches(data, inside, delimiter)
    k = np.searchsorted(starts, breaks, "right") - 1  # the last stretch that starts before
    within = (k >= 0) & (breaks < np.asarray([*ends, 0])[k])
    return breaks[~within] + 1, still


def _opened(file: str):
    store, at = file_system(file)
    return store.open_input_file(at)


def _each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row per task."""
    return spark.createDataFrame(rows, schema).coalesce(1).repartition(max(1, len(rows)))


def _read_spans(spark: SparkSession, listed: list[tuple[str, int]], shape: Shape, skip: int, most: int) -> DataFrame:
    """Files by spans of whole lines. What a span's bytes mean depends on whether it begins within quotes.

    One job finds the first line break of each range; one reads each span under both assumptions and tells how it would
    end; these pairs, a row per span, are followed from each file's start; then each task cuts the records that begin in
    its span, the last of which may run on, and Spark's parser takes them apart. CRLF in quotes becomes LF. A quote that
    is never closed runs to the end of its file.
    """
    delimiter, encoding = shape.delimiter, shape.encoding.removesuffix("-sig")
    most = paced(sum(size for _, size in listed), most, spark.sparkContext.defaultParallelism)
    ranges = [(f, low, high) for f, size in listed for low, high in _cuts(size, most)]

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, low, high in zip(frame["file"], frame["low"], frame["high"]):
                with _opened(file) as f:
                    at, found = max(low - 1, 0), 0 if low == 0 else -1
                    while found < 0 and at < high:
                        piece = f.read_at(min(SAMPLE_BYTES, high - at), at)
                        k = piece.find(b"\n")
                        found, at = (at + k + 1 if k >= 0 else -1), at + len(piece)
                yield pd.DataFrame({"file": [file], "start": [found]})

    found = sorted((r["file"], r["start"]) for r in _each(spark, ranges, "file string, low long, high long").mapInPandas(starts, "file string, start long").where("start >= 0").collect())
    sizes = dict(listed)
    spans = [(f, s, following if g == f else sizes[f]) for (f, s), (g, following) in zip(found, [*found[1:], ("", 0)]) if s < sizes[f]]

    def states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, low, high in zip(frame["file"], frame["low"], frame["high"]):
                with _opened(file) as f:
                    data = f.read_at(high - low, low)
                yield pd.DataFrame({"file": [file], "low": [low], "high": [high], "after_out": [quoted_stretches(data, False, delimiter)[2]], "after_in": [quoted_stretches(data, True, delimiter)[2]]})

    if len(spans) > len(listed):
        ended = _each(spark, spans, "file string, low long, high long").mapInPandas(states, "file string, low long, high long, after_out boolean, after_in boolean")
        inside, placed, now = False, [], None
        for r in sorted(ended.collect()):  # a row per span
            inside = inside and r["file"] == now
            now = r["file"]
            placed.append((now, r["low"], r["high"], inside))
            inside = r["after_in"] if inside else r["after_out"]
    else:
        placed = [(*s, False) for s in spans]  # one span a file

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(r["file"]) as f:
                    for texts in _batched(_records_of(f, r["low"], r["high"], r["inside"], delimiter, encoding, skip if r["low"] == 0 else 0)):
                        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["record"])

    texts = _each(spark, placed, "file string, low long, high long, inside boolean").mapInArrow(cut, "record string")
    parsed = texts.select(F.from_csv("record", _schema(shape), {"sep": delimiter, "quote": '"', "escape": '"'}).alias("r"))
    return parsed.select("r.*")


def _cuts(size: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a file; the first is long enough for what stands before the rows."""
    low, high = 0, max(most, SAMPLE_BYTES)
    while low < size:
        yield low, min(high, size)
        low, high = high, high + most


def _records_of(f: pa.NativeFile, low: int, high: int, inside: bool, delimiter: str, encoding: str, skip: int) -> Iterator[str]:
    """The records that begin in a span, without blank lines and the first ``skip`` others."""
    data = f.read_at(high - low, low)
    ends, still = record_ends(data, inside, delimiter)
    places = ([] if inside else [0]) + ends.tolist()
    if not places:
        return
    rest, at, step = data[places[-1] :], high, SAMPLE_BYTES
    while still and (more := f.read_at(step, at)):  # the last record runs on
        at, step, rest = at + len(more), 2 * step, rest + more
        own, still = record_ends(rest, False, delimiter)
        if len(own):
            rest, still = rest[: own[0]], False
        elif not still and at < f.size():
            still = True  # out of the quotes, but not at the end of the line
    pieces = itertools.chain((data[a:b] for a, b in itertools.pairwise(places)), [rest])
    if low == 0 and data.startswith(b"\xef\xbb\xbf"):
        pieces = itertools.chain([next(pieces)[3:]], pieces)
    for piece in pieces:
        text = piece.decode(encoding, "replace").replace("\r\n", "\n").rstrip("\n")
        if not text.strip():
            continue
        if skip:
            skip -= 1
            continue
        yield text


def _batched(texts: Iterator[str]) -> Iterator[list[str]]:
    """Lists of texts of some megabytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > 1 << 22:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_fast(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated with a header in the first line: Spark's own reader."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``x y id``: shapes are the ids, a line where an id repeats and else a point."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(part[0].cast("double").alias("x"), part[1].cast("double").alias("y"), part[2].alias("id"), F.monotonically_increasing_id().alias("seq"))
    sizes = rows.groupBy("id").agg(F.when(F.count("*") > 1, "line_strip").otherwise("points").alias("shape_type"))
    return rows.join(sizes, "id")
