"""Shared pieces of the training-data operators: tables, shared folders and vectorised text cutting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of every contract here: space and the bytes 9 to 13. UTF-8 continuation bytes never match.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"

#: Odd multipliers of the polynomial hashes modulo 2**64, and of the finaliser.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
STEP_A, STEP_B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MASK64 = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a default only where it is unset."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # the rows are in the table now: this job's shuffle files go when it ends
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(clean, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._millrace_path = path
    return back


def discard(df: DataFrame) -> None:
    """Removes a table of ``written()`` once nothing reads it any more."""
    spark, path = df.sparkSession, df._millrace_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Bytes of text that one worker holds as a group: chunks and buckets are so many that their means are below.
CHUNK_BYTES = 16 << 20


def chunk_count(docs: DataFrame, column: str = "text") -> int:
    """How many chunks the texts are dealt into: by their bytes, and at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // CHUNK_BYTES), 1)


def id_string(col: str = "doc_id"):
    return F.col(col).cast("string")


def crc_mod(n: int, col: str = "doc_id"):
    """crc32 of the id as text modulo ``n``; null ids count as the empty text."""
    return (F.crc32(F.coalesce(id_string(col), F.lit("")).cast("binary")) % n).cast("int")


#: SQL of crc32, for the queries whose contracts take it of an id: a table of one row, crc32_table(crc_of).
CRC32_TABLE_SQL = """crc32_steps as (
  select range k, list_reduce(list_prepend(cast(range as bigint), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) v from range(256)
), crc32_table as (select list(v order by k) crc_of from crc32_steps)"""


def crc32_sql(column: str) -> str:
    """crc32 of an integer as text (null: of the empty text), next to crc32_table."""
    codes = f"list_transform(string_split(cast({column} as varchar), ''), lambda x: cast(ascii(x) as bigint))"
    return f"case when {column} is null then 0 else xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) end"


def text_column(batch: pa.RecordBatch, name: str) -> pa.LargeBinaryArray:
    """A text column as bytes with 64-bit offsets; nulls stay nulls."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type) or pa.types.is_string(col.type):
        return col.cast(pa.large_string()).view(pa.large_binary())
    return col.cast(pa.large_binary())


def chunks(col: pa.LargeBinaryArray, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) with their bytes and offsets (from 0), about ``most`` bytes at a time; one long text stands alone.

    Null texts have no bytes.
    """
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words begin (length texts + 1)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = np.empty(n + 1, dtype=bool)
    gap[1:] = SPACE[data]
    gap[0] = True
    solid = ~gap[1:]
    before = gap[:-1].copy()
    inner = offsets[:-1]
    before[inner[inner < n]] = True
    starts = np.flatnonzero(solid & before)
    after = np.empty(n, dtype=bool)
    after[:-1] = gap[2:]
    after[-1] = True
    ends_at = offsets[1:] - 1
    after[ends_at[ends_at >= 0]] = True
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        up, down = (np.full(size, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        if size > 1 << 21:
            _POWERS.pop(base, None)
            return np.cumprod(up, out=up), np.cumprod(down, out=down)
        have = _POWERS[base] = (np.cumprod(up, out=up), np.cumprod(down, out=down))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span, from one prefix sum: sum of value*base**k, shifted back by base**-s."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


#: Spans of up to so many bytes are hashed side by side, eight bytes at a time; longer ones one by one.
LANE_BYTES = 256
LANE_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of the bytes of each span: a chain of bijective mixing steps over its length and its eight-byte lanes.

    Unlike a polynomial modulo 2**64 it has no inputs that collide whatever the constants; two seeds give
    independent keys.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(STEP_A) + np.uint64(seed))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.array(np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,)))
    active, at = np.flatnonzero((size > 0) & (size <= LANE_BYTES)), 0
    while len(active):
        left = size[active] - at
        lane = lanes[starts[active] + at] & LANE_MASKS[np.minimum(left, 8)]
        out[active] = mix(out[active] ^ lane)
        active, at = active[left > 8], at + 8
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed & MASK64)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = BASE_A) -> np.ndarray:
    return span_keys(data, starts, ends, seed)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, compared byte by byte; numbers count from 0."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    packed = data[spread(starts, size)]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each group of ``size``, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and at ``b`` are the same, compared byte by byte, about ``part`` at a time."""
    out = np.ones(len(size), bool)
    up_to, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(up_to, (up_to[lo - 1] if lo else 0) + part, side="right")))
        n = size[lo:hi]
        full = np.flatnonzero(n)
        if len(full):
            n = n[full]
            same = data[spread(a[lo:hi][full], n)] == data[spread(b[lo:hi][full], n)]
            out[lo + full] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        lo = hi
    return out


def rolling(values: np.ndarray, width: int, base: int = STEP_A) -> np.ndarray:
    """The hash of each ``width`` consecutive values, at each place up to the last full window: span_hashes by slices."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    step = values.astype(np.uint64)
    step += np.uint64(1)
    step *= up[: len(values)]
    np.cumsum(step, out=total[1:])
    out = total[width:] - total[:n]
    out *= down[:n]
    return mix(out)


def _give_back() -> None:
    """Returns what this worker no longer uses to the system: workers outlive tasks and share a machine."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows of a batch between Spark and a worker: whole documents travel, and the default of 10000 is for narrow rows.
BATCH_ROWS = 1000


def _small_batches() -> None:
    """Lowers the session's batch size to BATCH_ROWS where it stands at its default."""
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def lean(fn):
    """A function over batches that leaves its worker small when the task ends."""
    _small_batches()

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return run


def lean_group(fn):
    """As ``lean``, for a function of one group's table."""
    _small_batches()

    def run(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return fn(table)
        finally:
            _give_back()

    return run


def lean_cogroup(fn):
    """As ``lean``, for a function of two tables."""
    _small_batches()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return fn(left, right)
        finally:
            _give_back()

    return run


def ascii_lower(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    return out
