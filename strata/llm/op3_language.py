"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound from the
vectors of its letters, rotated by their place, and multiplied; a text or a
language is the sum (bundle) of its trigram vectors; texts are compared with
languages by cosine (Joshi, Halseth and Kanerva 2016, "Language Geometry using
Random Indexing").
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mapped, table

DIM = 512
CHUNK_CHARS = 1 << 19
SEED = 29
_state: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letter" not in _state:
        _state["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _state["letter"]


def letter_vector(code: int) -> np.ndarray:
    """The +1 and -1 of a letter, by its code point (0: the gap between words); each letter has its own."""
    raw = hashlib.shake_256(f"{SEED}:{code}".encode()).digest(DIM // 8)
    return np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) * 2 - 1


_cached_vector = functools.lru_cache(maxsize=20_000)(letter_vector)


def _pieces(texts: list[str | None]):
    """(row, lower-case piece, goes on from the one before, goes on in the next).

    Pieces of a long text share two characters, not both of them gaps, so that
    each trigram is in one piece.
    """

    def apart(text, cut):
        return not any(c.isalpha() for c in text[cut - 2 : cut]) or len(text[cut - 2 : cut].lower()) > 2

    for row, text in enumerate(texts):
        if not text:
            continue
        at, n = 0, len(text)
        while n - at > CHUNK_CHARS:
            cut = at + CHUNK_CHARS
            while cut > at + CHUNK_CHARS // 2 and apart(text, cut):
                cut -= 1
            while cut < n and apart(text, cut):
                cut += 1
            if cut == n:
                break
            yield row, text[at:cut].lower(), at > 0, True
            at = cut - 2
        yield row, text[at:].lower(), at > 0, False


def _bundle(rows: np.ndarray, parts: list[str], inner: list[tuple[bool, bool]], out: np.ndarray) -> None:
    """Add the trigram vectors of each part to its row of out; an inner end of a part is no gap."""
    codes = np.frombuffer(" ".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    # every part stands between two blanks; a blank belongs to the part after it, and is given again to the one before
    owner = np.repeat(np.arange(len(parts)), lens + 2)
    starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(lens + 2)])[:-1], lens + 2) + np.repeat(starts, lens + 2)
    z = np.where(_is_letter()[codes[at]], codes[at], 0).astype(np.int64)
    ends = np.cumsum(lens + 2)
    real = np.ones(len(z), bool)
    real[(ends - lens - 2)[[a for a, _ in inner]]] = False
    real[(ends - 1)[[b for _, b in inner]]] = False
    z, owner = z[real], owner[real]
    keep = np.ones(len(z), bool)
    keep[1:] = (z[1:] > 0) | (z[:-1] > 0) | (owner[1:] != owner[:-1])
    z, owner = z[keep], owner[keep]
    ok = owner[2:] == owner[:-2]
    a, b, c, who = z[:-2][ok], z[1:-1][ok], z[2:][ok], owner[2:][ok]
    some = (a + b + c) > 0
    a, b, c, who = a[some], b[some], c[some], who[some]
    if not len(a):
        return
    present = np.zeros(int(z.max()) + 1, bool)
    present[z] = True
    local = np.flatnonzero(present)
    index = np.zeros(len(present), np.int64)
    index[local] = np.arange(len(local))
    m = len(local)
    key = (index[a] * m + index[b]) * m + index[c]
    if m**3 <= 1 << 22:
        present = np.flatnonzero(np.bincount(key, minlength=m**3))
        place = np.zeros(m**3, np.int32)
        place[present] = np.arange(len(present))
        inv = place[key]
    else:
        present, inv = np.unique(key, return_inverse=True)
    plain = np.stack([_cached_vector(c) for c in local.tolist()])
    v2, v1, v0 = (np.roll(plain, k, axis=1) for k in (2, 1, 0))
    for lo in range(0, len(present), 8192):
        g = present[lo : lo + 8192]
        vec = (v2[g // (m * m)] * v1[g // m % m] * v0[g % m]).astype(np.float32)
        here = slice(None) if len(present) <= 8192 else (inv >= lo) & (inv < lo + len(g))
        for first in range(0, len(parts), 512):
            n = min(512, len(parts) - first)
            w, i = who[here] - first, inv[here] - lo
            if len(parts) > 512:
                mine = (w >= 0) & (w < n)
                w, i = w[mine], i[mine]
            counts = np.bincount(w.astype(np.int64) * len(g) + i, minlength=n * len(g)).reshape(n, len(g)).astype(np.float32)
            np.add.at(out, rows[first : first + n], counts @ vec)


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """One bundle per text, of whole numbers; zero where a text is null or has no letter."""
    out = np.zeros((len(texts), DIM), np.float64)
    rows, parts, inner, size = [], [], [], 0
    for row, piece, *ends in _pieces(texts):
        rows.append(row)
        parts.append(piece)
        inner.append(tuple(ends))
        size += len(piece)
        if size >= CHUNK_CHARS:
            _bundle(np.array(rows), parts, inner, out)
            rows, parts, inner, size = [], [], [], 0
    if parts:
        _bundle(np.array(rows), parts, inner, out)
    return out


def _slices(batch, size=1000):
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def _learn(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in _slices(batch):
            vec = document_vectors(part.column("text").to_pylist())
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + vec[langs == lang].sum(axis=0)
    for lang, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM), pa.int32()), pa.array(v.astype(np.int64))], ["lang", "dim", "value"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and the unit vector of each, bundled from all rows of docs (text, lang).

    Each task sends DIM whole numbers for each of its languages, whose sums do
    not depend on their order; the driver gets DIM numbers for each language.
    """
    rows = mapped(docs.filter("lang is not null and text is not null").select("text", "lang"), _learn, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), DIM))
    place = {x: k for k, x in enumerate(langs)}
    for r in rows:
        out[place[r["lang"]], r["dim"]] = r["value"]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    ok = norm[:, 0] > 0
    return [x for x, k in zip(langs, ok, strict=True) if k], out[ok] / norm[ok]


def _predictor(langs, protos):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                vec = document_vectors(part.column("text").to_pylist())
                norm = np.linalg.norm(vec, axis=1)
                some = (norm > 0) & bool(len(langs))
                cos = (vec @ protos.T / np.maximum(norm, 1e-300)[:, None]) if len(langs) else np.zeros((len(vec), 1))
                best = cos.argmax(axis=1)
                pred = [langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some, np.round(np.clip((1 + cos[np.arange(len(vec)), best]) / 2, 0, 1), 9), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Learns from rows with a lang that are not held out.  A null text or one
    without a letter is ``und`` with score 0, as is everything when nothing
    could be learned.  Equal cosines go to the smaller language value.  score is
    (1 + cosine) / 2.  A null doc_id is not held out.  Extra columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    langs, protos = prototypes(rows.filter("not held_out"))
    return mapped(rows.select("doc_id", "text", "held_out"), _predictor(langs, protos), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    return identified(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 1)
