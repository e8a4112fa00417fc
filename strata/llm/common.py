"""Shared parts: checkpoints, hashed words and shingles, and nested cut search."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of bytes other than space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
#: Bytes of text that one numpy step handles (a longer single text goes alone).
CHUNK_BYTES = 1 << 20
#: Tables of one row per group are broadcast only up to this checked row count.
BROADCAST_ROWS = 50_000
KEY_BITS = 60
LEVEL_BITS = 10
#: Bytes of whole texts that go to a Python worker at once (a longer text goes alone).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Where it names none: one in the warehouse, which is shared, or in local
    mode, as in tests, a temporary one.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            named = tempfile.mkdtemp(prefix="strata-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/strata-checkpoint"
        sc.setCheckpointDir(named)
        here = sc.getCheckpointDir()
    return here


def materialize(df: DataFrame, written: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder, whose path is added to ``written``.

    Unlike a checkpoint, a table read again has its true size, from which
    Spark plans joins; sizes estimated from a checkpoint's origin multiply from
    one round of a loop to the next.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables that nothing reads any more."""
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return memory that a Python worker has freed, which its next task would else find taken."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow for whole texts: small batches, and the memory goes back when a partition ends.

    The session's bound on a batch's bytes is lowered to BATCH_BYTES.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def local_frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows of the driver as a table; unlike rows given as they are, it starts no Python worker on executors."""
    names = [c.split() for c in columns.split(", ")]
    arrays = [pa.array([r[k] for r in rows], _ARROW[kind]) for k, (_, kind) in enumerate(names)]
    return spark.createDataFrame(pa.table(arrays, [n for n, _ in names]))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count was checked; plain (skew-splittable) join beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def hash_key(*cols: Column) -> Column:
    """A 60-bit key from md5, the same in every engine; null columns count as empty text."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def nested_cuts(items: DataFrame, budgets: DataFrame, groups: int) -> DataFrame:
    """Per group, the largest key whose items, taken in key order, come nearest to a budget.

    items: grp, key (long in [0, 2**60)), weight.  budgets: grp, budget (one row
    per group, ``groups`` rows).  Returns grp, cut: items with key <= cut are
    taken.  Weights are summed by group and key range of 2**10 parts; only the
    range in which the budget ends is split again, so nothing is sorted.  Items
    with equal keys are taken or left together, whichever is nearer the budget.
    """
    state = budgets.select("grp", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"), F.lit(None).cast("long").alias("cut"))
    for level in range(1, KEY_BITS // LEVEL_BITS + 1):
        shift = KEY_BITS - LEVEL_BITS * level
        left = state.filter(F.col("cut").isNull())
        inside = items.alias("i").join(small_side(left, groups).alias("s"), F.col("i.grp").eqNullSafe(F.col("s.grp")) & (F.shiftright("i.key", shift + LEVEL_BITS) == F.col("s.prefix")))
        parts = inside.groupBy(F.col("s.grp").alias("grp"), F.shiftright("i.key", shift).alias("part")).agg(
            F.sum("weight").cast("double").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("w").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        ends = parts.withColumn("upto", upto).withColumn("past", F.col("upto") > F.col("budget"))
        # the first range that does not fit; with none, all is taken
        found = ends.groupBy("grp").agg(
            F.min(F.when(F.col("past"), F.struct("part", "upto", "w", "lo", "hi"))).alias("b"),
            F.max("hi").alias("last"), F.first("budget").alias("budget"))
        prior = F.col("b.upto") - F.col("b.w")
        one = F.when(prior + F.col("b.upto") <= 2 * F.col("budget"), F.col("b.lo")).otherwise(F.col("b.lo") - 1)
        step = found.select("grp", "budget", F.coalesce(F.col("b.part"), F.lit(0)).alias("prefix"), F.coalesce(prior, F.lit(0.0)).alias("before"),
                            F.when(F.col("b").isNull(), F.lit((1 << KEY_BITS) - 1)).when(F.col("b.lo") == F.col("b.hi"), one).cast("long").alias("cut"))
        state = materialize(state.filter(F.col("cut").isNotNull()).unionByName(step))
        if state.filter(F.col("cut").isNull()).isEmpty():
            break
    return state.select("grp", "cut")


# --- hashed words -----------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        out[0] = 1
        have = _powers[key] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _words(data: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    word = ~_SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code[data] * _power(_BASE, n), out=total[1:])
    return mix((total[e] - total[s]) * _power(_INVERSE, n)[s]), s, e


def _cut_at_space(data: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of one long text that end between words; a word longer than a piece stays whole."""
    at = 0
    while at < len(data):
        to = min(at + CHUNK_BYTES, len(data))
        if to < len(data):
            back = np.flatnonzero(_SEPARATOR[data[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                ahead = to
                while ahead < len(data) and not _SEPARATOR[data[ahead]]:
                    ahead += 1
                to = ahead
        yield data[at:to]
        at = to


def row_ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, a longer row alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def word_hashes(texts: pa.Array, code: np.ndarray = _CODE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the range's words, word bounds of its rows), range by range."""
    data, offsets = text_buffer(texts)
    for lo, hi in row_ranges(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(part) > 2 * CHUNK_BYTES:
            h = np.concatenate([_words(p, np.array([0, len(p)]), code)[0] for p in _cut_at_space(part)])
            yield lo, h, np.array([0, len(h)])
        else:
            h, s, _ = _words(part, off, code)
            yield lo, h, np.searchsorted(s, off)


def _joined(words: list[np.ndarray]) -> np.ndarray:
    return mix(sum((w * _PLACE[k] for k, w in enumerate(words)), np.zeros_like(words[0])) + np.uint64(len(words)))


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct 64-bit hashes of its word shingles.

    Fewer words than a shingle: the whole sequence counts as one shingle.  No
    words, or null: an empty set.
    """
    none = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for _, h, bounds in word_hashes(texts):
            rolled = _joined([h[k : len(h) - words + 1 + k] for k in range(words)]) if len(h) >= words else none
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= words:
                    out = np.sort(rolled[a : b - words + 1])
                    if len(out) > 1:
                        fresh = np.empty(len(out), bool)
                        fresh[0] = True
                        np.not_equal(out[1:], out[:-1], out=fresh[1:])
                        out = out[fresh]
                    yield out
                elif b > a:
                    yield _joined([h[k : k + 1] for k in range(a, b)])
                else:
                    yield none


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
