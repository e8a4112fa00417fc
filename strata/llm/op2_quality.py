"""Quality classifier by importance resampling.

Two generative models over hashed byte n-grams, one of labelled good documents
and one of the whole corpus, give every document its importance weight, the log
ratio of their likelihoods.  A Gumbel number per document is added and the top
k are taken (Xie et al. 2023, "Data Selection for Language Models via
Importance Resampling").  k is the number of documents whose ratio reaches the
level that best parts labelled good from labelled bad documents.

A weight counts the ratio of EVIDENCE n-grams at most, at the document's mean.
Neighbouring n-grams overlap and words repeat, so the sum over thousands of
them overstates what they tell; it would also put documents hundreds of nats
apart, where Gumbel numbers, a few nats apart, decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, KEY_BITS, crc_mod, mapped, materialize, nested_cuts, row_ranges, table, text_buffer, unused

GRAM = 5
BUCKET_BITS = 17
#: Labelled rows used at most, those with the smallest hash of doc_id.
MAX_LABELLED = 20_000
#: A bucket's ratio is drawn to 1 by as much evidence as this many n-grams.
SHRINK = 5.0
#: N-grams that a document's weight counts at most.
EVIDENCE = 40
SEED = 17
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _buckets(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(31) + (data[k : n + k].astype(np.uint32) + np.uint32(1)) * _FACTORS[k]
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of bounded size; a long row comes as several pieces that overlap by GRAM - 1."""
    for lo, hi in row_ranges(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * CHUNK_BYTES:
            yield lo, data[a:b], offsets[lo : hi + 1] - a
        else:
            for at in range(a, b, CHUNK_BYTES):
                part = data[at : min(at + CHUNK_BYTES + GRAM - 1, b)]
                yield lo, part, np.array([0, len(part)])


def _valid(n: int, off: np.ndarray) -> np.ndarray:
    ok = np.ones(n, bool)
    for k in range(1, GRAM):
        edge = off[1:] - k
        ok[edge[(edge >= 0) & (edge < n)]] = False
    return ok


def _row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return np.diff(total[np.minimum(off, len(values))])


def _gather(batches):
    raw, good = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        is_good = np.array([x is True for x in batch.column("good").to_pylist()], bool)
        for lo, part, off in _pieces(data, offsets):
            h = _buckets(part)
            ok = _valid(len(h), off)
            raw += np.bincount(h[ok], minlength=len(raw))
            for r in np.flatnonzero(is_good[lo : lo + len(off) - 1]).tolist():
                g = h[off[r] : max(off[r], min(off[r + 1] - GRAM + 1, len(h)))]
                good += np.bincount(g, minlength=len(good))
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """docs with ``column`` from at most ``limit`` labels (by hash of doc_id), null elsewhere."""
    picked = labels.select(F.col("doc_id").alias("label_id"), F.col(column).alias("label")).filter("label_id is not null and label is not null")
    picked = picked.groupBy("label_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    return docs.join(F.broadcast(materialize(picked)), F.col("doc_id") == F.col("label_id"), "left")


def models(raw: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the buckets in good documents and in all, each smoothed and summing to 1.

    Both are seen through as many n-grams as the good ones, so that buckets
    with little evidence come out alike.
    """
    total = good.sum() + SHRINK * len(good)
    seen = raw * (good.sum() / max(raw.sum(), 1))
    if not good.sum() or not raw.sum():
        return np.full(len(raw), -np.log(len(raw))), np.full(len(raw), -np.log(len(raw)))
    return np.log((good + SHRINK) / total), np.log((seen + SHRINK) / total)


def log_ratios(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, np.ndarray, float]:
    """(doc_id, grams, log_ratio) per row of docs, the bucket table and the level that parts good from bad."""
    seen = labelled(docs.select("doc_id", "text"), labels, "quality", max_labelled)
    fit = F.col("label").isNotNull() & (crc_mod(F.col("doc_id"), 2) == 0)
    counts = mapped(seen.select("text", (fit & (F.col("label") == 1)).alias("good")), _gather, "bucket int, raw long, good long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # 2**BUCKET_BITS rows at most
    raw, good = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    of_good, of_all = models(raw, good)
    ratio = (of_good - of_all).astype(np.float32)
    scores = materialize(mapped(seen, _scorer(ratio), "doc_id long, grams long, log_ratio double, label int"))
    held = scores.filter((F.col("grams") > 0) & F.col("label").isNotNull() & (crc_mod(F.col("doc_id"), 2) == 1)).select("log_ratio", "label").collect()  # max_labelled rows at most
    return scores, ratio, _level([(r[0], r[1]) for r in held])


def _level(held: list[tuple[float, int]]) -> float:
    """The lowest cut whose balanced accuracy is within a hundredth of the best; with one class only, below all."""
    held = sorted(held)
    x, y = np.array([h[0] for h in held]), np.array([h[1] == 1 for h in held], bool)
    if not len(x) or y.all() or not y.any():
        return float(x[0]) - 1.0 if len(x) else -1.0
    bad_below = np.concatenate([[0], np.cumsum(~y)]) / (~y).sum()
    good_above = 1 - np.concatenate([[0], np.cumsum(y)]) / y.sum()
    gain = bad_below + good_above
    gaps = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    k = np.flatnonzero(gain >= gain.max() - 0.02)[0]
    return float((gaps[k] + gaps[k + 1]) / 2)


def _sums(batch, ratio):
    data, offsets = text_buffer(batch.column("text"))
    total = np.zeros(len(offsets) - 1)
    for lo, part, off in _pieces(data, offsets):
        h = _buckets(part)
        v = np.where(_valid(len(h), off), ratio[h], np.float32(0))
        total[lo : lo + len(off) - 1] += _row_sums(v, off)
    return total, np.maximum(np.diff(offsets) - GRAM + 1, 0)


def _scorer(ratio):
    def run(batches):
        for batch in batches:
            total, grams = _sums(batch, ratio)
            mean = np.round(total / np.maximum(grams, 1), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(grams.astype(np.int64)), pa.array(mean), batch.column("label").cast(pa.int32())], ["doc_id", "grams", "log_ratio", "label"])

    return run


def gumbel(doc_id, seed: int = SEED):
    """A standard Gumbel number from a hash of doc_id, the same on every run."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _with_keys(scores: DataFrame, seed: int) -> DataFrame:
    weight = F.least(F.col("grams"), F.lit(EVIDENCE)) * F.col("log_ratio")
    return scores.withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))


def _rank_key(gumbel_key):
    """A long in [0, 2**60) that falls as the Gumbel key rises; keys beyond +-10**6 tie at the ends."""
    span = float((1 << KEY_BITS) - 1)
    return F.least(F.greatest((0.5 - gumbel_key / 2e6) * span, F.lit(0.0)), F.lit(float((1 << KEY_BITS) - 1024))).cast("long")


def select_top(scores: DataFrame, level: float, seed: int = SEED) -> DataFrame:
    """The k documents with the largest Gumbel keys, k being the number at or above the level (or without n-grams)."""
    keyed = _with_keys(scores, seed).withColumn("key", _rank_key(F.col("gumbel_key")))
    k = keyed.agg(F.count_if((F.col("grams") == 0) | (F.col("log_ratio") >= F.lit(level)))).first()[0]
    budget = keyed.sparkSession.range(1).select(F.lit("all").alias("grp"), F.lit(float(k)).alias("budget"))
    cut = nested_cuts(keyed.select(F.lit("all").alias("grp"), "key", F.lit(1).alias("weight")), budget, 1).first()
    return keyed.filter(F.col("key") <= (cut["cut"] if cut else -1)).drop("key")


def resampled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """doc_id, grams, log_ratio, log_weight, gumbel_key of the documents taken.

    Null texts and texts below GRAM bytes have no n-gram and weight 0, so the
    Gumbel number alone ranks them.  Rows with equal doc_id and text get equal
    keys and go together.  With no usable label every document has ratio 0 and
    all are taken.  Extra columns of docs are ignored; an empty table gives no rows.
    """
    scores, _, level = log_ratios(docs, labels, max_labelled)
    return select_top(scores, level, seed).drop("label")


def query(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark, docs, sf_dir):
    """Documents whose Gumbel key is among the top k, in the columns of docs.

    The key of a text is worked out again beside the text, so that no text
    crosses a shuffle; only the cut, one number, is carried over.
    """
    scores, ratio, level = log_ratios(docs, table(spark, sf_dir, "labels"))
    lowest = select_top(scores, level).agg(F.min("gumbel_key")).first()[0]
    if lowest is None:
        return docs.limit(0)
    names, extra = docs.columns, unused(docs, "gumbel")
    rows = docs.withColumn(extra, gumbel(F.col("doc_id").cast("long")))

    def run(batches):
        for batch in batches:
            total, grams = _sums(batch, ratio)
            mean = np.round(total / np.maximum(grams, 1), 9)
            key = np.minimum(grams, EVIDENCE) * mean + batch.column(extra).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(key >= lowest - 1e-9)).select(names)

    return mapped(rows, run, docs.schema)
