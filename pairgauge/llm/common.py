"""Shared pieces: word pattern, shared-folder tables, block numbers, vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Text bytes a Python task takes up at once.
BLOCK_BYTES = 12 << 20
#: Rows up to which a two-column side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_MADE: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once a row, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="pairgauge-")
        _MADE[app] = f"{top.rstrip('/')}/pairgauge-{app}"
        atexit.register(drop_table, spark, _MADE[app])
    return _MADE[app]


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table; a session that has ended is no error."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


_HELD: dict[tuple[str, str], list] = {}
_LOCK = threading.Lock()


@contextlib.contextmanager
def _set(spark: SparkSession, **settings: str):
    """Settings of the session for as long as a write takes; writes of several threads may overlap."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        for k, v in settings.items():
            held = _HELD.setdefault((app, k), [0, spark.conf.get(k, None)])
            held[0] += 1
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _LOCK:
            for k in settings:
                held = _HELD[app, k]
                held[0] -= 1
                if not held[0]:
                    before = _HELD.pop((app, k))[1]
                    spark.conf.unset(k) if before is None else spark.conf.set(k, before)


def table(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. batch_rows: rows that go to a Python
    worker at once, where they are whole texts and memory is short."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    # this step's shuffle files go with it, on all executors; nothing else reads them
    settings = {_CLEAN: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    with _set(spark, **settings):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairgauge_path = path
    return out


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    longest = max(map(len, df.columns), default=0)
    return [f"{n}{'_' * (longest + 1)}" for n in names]


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has so few rows that it may be broadcast."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if few(df, rows) else df


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(col).cast("binary")))).first()[0] or 0)


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-total_bytes // block_bytes))


def block_of(n: int, *cols: str) -> Column:
    """A block number from the row's content: equal after any re-run of a task."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def return_memory(least: int = 4 << 20) -> None:
    """Have this worker give large arrays back when they are dropped, and now what is free: glibc otherwise
    raises the size from which it does so with every array, and keeps the pieces for workers' later tasks.
    No other C library needs it."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, least)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


# -- vectorised hashing -------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n, by doubling."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done, step = 1, b
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            both.append(p)
        have = _POWERS[0] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**i modulo 2**64; entry i covers the first i bytes."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * mix(_VALUE)[b] * _powers(len(b))[0], out=out[1:])
    return out


_VALUE = np.arange(1, 257, dtype=np.uint64) * _ODD


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""
    inverse = _powers(len(prefix))[1]
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix(h ^ (np.asarray(end - start).astype(np.uint64) * _ODD))


# -- texts as bytes ------------------------------------------------------------------------

#: Bytes that one step of vectorised work takes up; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Whole texts that go to a Python worker at once.
TEXT_ROWS = 2000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def steps(column, step_bytes: int = STEP_BYTES):
    """(first row, bytes, offsets) of runs of rows of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_binary(column.type) else pa.large_string()
    col = column.fill_null("").cast(kind) if column.null_count else column.cast(kind)
    n = len(col)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step_bytes, "right")) - 1)
        yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row each word is in; words end with their row."""
    letter = np.concatenate([[False], ~SPACE[data], [False]])
    first = letter[1:-1].copy()
    first[1:] &= ~letter[1:-2]
    inner = offsets[(offsets < len(data))]
    first[inner] = letter[1:-1][inner]
    last = letter[1:-1].copy()
    last[:-1] &= ~letter[2:-1]
    inner = offsets[offsets > 0] - 1
    last[inner] = letter[1:-1][inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes; fewer words are one shingle."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    words_ = span_hash(prefix_hash(data), starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    at = np.concatenate([[0], np.cumsum(counts)])
    if len(words_) >= k:
        h = np.zeros(len(words_) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + mix(words_[j : len(words_) - k + 1 + j] + np.uint64(j))
        h = mix(h)
    else:
        h = np.empty(0, np.uint64)
    out = []
    for i in range(n):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= k:
            out.append(np.unique(h[lo : hi - k + 1]))
        elif hi > lo:
            v = np.array([hi - lo], np.uint64)
            for w in words_[lo:hi]:
                v = mix(v * np.uint64(0x9FB21C651E98DF25) ^ w)
            out.append(v)
        else:
            out.append(np.empty(0, np.uint64))
    return out
