"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the k smallest 48-bit hashes of a text's distinct word
shingles.  Fingerprints of parts merge into that of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles
(Broder 1997; Cohen and Kaplan 2007).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, shingle_sets, table

K = 64
HASH_BITS = 48
#: Documents dealt to a task, until there are MAX_PARTS tasks.
PART_DOCS = 2000
MAX_PARTS = 20_000
_GHOST = 1 << 30
_NULL_ID = -(1 << 63)


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest hashes of a sorted array of distinct 64-bit ones."""
    low = shingles[:k] >> np.uint64(64 - HASH_BITS)
    return low if len(low) < 2 or (low[1:] != low[:-1]).all() else np.unique(low)


def encode(low: np.ndarray) -> str:
    return base64.b64encode(low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The fingerprint of two parts together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else estimated from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**HASH_BITS / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness, 0 to 1; of two empty texts 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    fresh = np.concatenate([[True], ~twice])
    last = np.flatnonzero(fresh)[: k]  # places of the k smallest of the union
    hit = np.concatenate([twice, [False]])[last]
    return float(hit.sum() / len(last))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds."""
    j, na, nb = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, j / (1 + j) * (na + nb) / na) if na else 1.0


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by the start of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _process(rows: list[tuple[int | None, str]], k: int):
    """Result rows of all but the last of ``rows``, each beside the row after it."""
    texts = [t for _, t in rows]
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own = [sketch(s, k) for s in shingle_sets(pa.array(texts, pa.large_string()))]
    new = [sketch(s, k) for s in shingle_sets(pa.array(changed, pa.large_string()))]
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array([encode(s) for s in own[:-1]], pa.string()), pa.array([encode(s) for s in new], pa.string()),
        pa.array([resemblance(a, b, k) for a, b in zip(own[:-1], new, strict=True)], pa.float64()),
        pa.array([resemblance(a, b, k) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STEP_CHARS = 1 << 19


def _walker(k: int):
    def run(batches):
        rows: list[tuple[int | None, str]] = []
        size, over = 0, False
        for batch in batches:
            for doc_id, text, ghost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ghost")), strict=True):
                if over:
                    continue
                rows.append((doc_id, text or ""))
                size += len(rows[-1][1])
                over = bool(ghost)
                if len(rows) > 1 and (size > STEP_CHARS or over):
                    yield _process(rows, k)
                    rows, size = rows[-1:], len(rows[-1][1])

    return run


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text, and their likeness.

    The following document is the next by falling doc_id, after the last the
    first.  Texts cross one shuffle: doc_id ranges of about equal counts go to
    a task each, and the first document of a range also goes to the end of the
    range before.  Null texts are empty.  Rows with equal doc_id follow each
    other by text; a null doc_id comes after all others.  A single document
    follows itself.  Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    count = docs.count()
    parts = max(1, min(MAX_PARTS, count // PART_DOCS))
    shares = [i / parts for i in range(1, parts)]
    splits = np.zeros(0, np.int64)
    if shares:
        got = docs.select(ids.alias("k")).agg(F.percentile_approx("k", shares, max(10_000, 20 * parts))).first()[0]
        splits = np.unique(np.array(got, np.int64))
    last = len(splits)

    @F.pandas_udf("int")
    def part_of(key):
        import pandas as pd

        return pd.Series((last - np.searchsorted(splits, key.to_numpy(), "left")).astype(np.int32))

    keyed = docs.select("doc_id", "text", ids.alias("k"))
    heads = docs.select(ids.alias("k")).groupBy(part_of("k").alias("part")).agg(F.max("k").alias("head")).collect()  # a row for each task
    order = sorted((r["part"], r["head"]) for r in heads)
    before = {head: order[i - 1][0] for i, (_, head) in enumerate(order)}
    heads_sorted = np.array(sorted(before), np.int64)
    ghosts = np.array([before[h] for h in heads_sorted.tolist()], np.int64)

    @F.pandas_udf("array<int>")
    def dealt(key):
        import pandas as pd

        x = key.to_numpy()
        part = last - np.searchsorted(splits, x, "left")
        at = np.minimum(np.searchsorted(heads_sorted, x), max(len(heads_sorted) - 1, 0))
        hit = heads_sorted[at] == x
        return pd.Series([[p, g | _GHOST] if h else [p] for p, g, h in zip(part.tolist(), ghosts[at].tolist(), hit.tolist(), strict=True)])

    rows = keyed.select("doc_id", "text", "k", F.explode(dealt("k")).alias("to"))
    rows = rows.select("doc_id", "text", "k", F.col("to").bitwiseAND(F.lit(_GHOST - 1)).alias("part"), (F.col("to") >= _GHOST).alias("ghost"))
    laid = rows.repartitionById(last + 1, F.col("part")).sortWithinPartitions("ghost", F.col("k").desc(), F.col("text").asc_nulls_first())
    return mapped(laid.select("doc_id", "text", "ghost"), _walker(k), SCHEMA)


def query(spark, sf_dir):
    return compared(table(spark, sf_dir, "documents"))
