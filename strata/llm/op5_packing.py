"""Best-fit packing of tokenized documents into sequences.

Vector best-fit decreasing: every sequence has residual token, document-count
and attention-cost capacities; a piece goes to the open sequence where it fits
under every constraint and leaves the least weighted residual norm (Panigrahy
et al. 2011, "Heuristics for Vector Bin Packing").  Pieces of one length are
alike, and so are sequences with equal residuals, so the plan is made on the
histogram of lengths, whose size does not grow with the corpus.  Each piece
then finds its place from its rank within its length.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _power, local_frame, mapped, materialize, mix, small_side, table

CAPACITY = 2048
#: Weights of the residual token, document-count and attention-cost capacities.
NORM_WEIGHTS = (1.0, 0.05, 0.2)
TOKENIZER = "word_bpe_49k.json"
#: Pieces that share a sequence in the pipeline at most, which bounds the segments of an attention mask.
STAGE_DOCUMENTS = 64
CHUNK_CHARS = 1 << 19
CACHE_WORDS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER, _NUMBER, _OTHER, _UNSAFE = 1, 2, 3, 9
_TOP = 0x2060


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and class of the code points that a word can be read from without the tokenizer's own normalizer."""
    import regex

    lower, kind = np.arange(_TOP + 1, dtype=np.uint32), np.full(_TOP + 1, _UNSAFE, np.uint8)
    safe = [*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
    for c in safe:
        low = chr(c).lower()
        if c == 0x27 or len(low) != 1 or ord(low) >= 0x250 > c:
            continue
        lower[c] = ord(low)
        kind[c] = 0 if regex.match(r"\s", low) else _LETTER if regex.match(r"\p{L}", low) else _NUMBER if regex.match(r"\p{N}", low) else _OTHER
    return lower, kind


class WordTokenizer:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and never merges across words, so the ids
    of a text are those of its words in turn.  Words are found with array
    operations and their ids kept; a text with characters that need the
    tokenizer's normalizer, an apostrophe or a special token's opening goes to
    the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.lower, self.kind = _tables()
        self.code = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, _TOP + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hash) > CACHE_WORDS:
            self.clear()
        lines = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            each = [self.whole(w) for w in words]
            ids, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
        first = np.concatenate([[0], last[:-1] + 1])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        where = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, where, hashes)
        self.at = np.insert(self.at, where, first + self.used)
        self.n = np.insert(self.n, where, last - first + 1)
        self.used += len(ids)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and a 0 at its end."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= CHUNK_CHARS:
                out += self._batch(group)
                group, size = [], 0
        return out + (self._batch(group) if group else [])

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        off = np.concatenate([[0], np.cumsum(lens)])
        codes = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)
        kind = self.kind[codes]
        odd = kind == _UNSAFE
        odd[:-1] |= (codes[:-1] == 0x3C) & (codes[1:] == 0x7C)
        slow = np.diff(np.concatenate([[0], np.cumsum(odd)])[off]) > 0
        if slow.any():
            kind[np.repeat(slow, lens)] = 0
        codes = self.lower[codes]
        n = len(codes)
        word = kind > 0
        first = np.zeros(n + 1, bool)
        first[off] = True
        turn = np.ones(n + 1, bool)
        turn[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | first[1:n]
        s, e = np.flatnonzero(word & turn[:n]), np.flatnonzero(word & turn[1:]) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.code[codes] * _power(_BASE, n), out=total[1:])
            h = mix((total[e] - total[s]) * _power(_INVERSE, n)[s])
        uniq, one, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(uniq):
            if len(self.hash) > CACHE_WORDS:
                self.clear()
            where = np.minimum(np.searchsorted(self.hash, uniq), max(len(self.hash) - 1, 0))
            fresh = np.ones(len(uniq), bool) if not len(self.hash) else self.hash[where] != uniq
            if fresh.any():
                lowered = codes.astype("<u4").tobytes().decode("utf-32-le")
                self._add(uniq[fresh], [lowered[a:b] for a, b in zip(s[one[fresh]].tolist(), e[one[fresh]].tolist(), strict=True)])
            where = np.searchsorted(self.hash, uniq)
            at, cnt = self.at[where][inv], self.n[where][inv]
        else:
            at = cnt = np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(cnt)])
        bounds = np.searchsorted(s, off)  # words of each text
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        ids = np.zeros(int(before[-1]) + len(texts), np.uint32)
        to = np.repeat(before[:-1] + doc, cnt) + (np.arange(int(before[-1])) - np.repeat(before[:-1], cnt))
        ids[to] = self.pool[np.repeat(at - before[:-1], cnt) + np.arange(int(before[-1]))]
        edge = before[bounds] + np.arange(len(texts) + 1)
        out = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        for k in np.flatnonzero(slow).tolist():
            out[k] = np.append(self.whole(texts[k]), np.uint32(0))
        return out


def _cutter(path: str | None, capacity: int):
    def run(batches):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        # the tokenizer goes when the partition ends: idle workers would each keep one
        tok = WordTokenizer(path or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                keys = part.column("doc_id").to_pylist()
                for doc_id, ids in zip(keys, tok.batch([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    for piece, a in enumerate(range(0, len(ids), capacity)):
                        x = ids[a : a + capacity]
                        rows.append((doc_id, piece, a, len(x), zlib.crc32(np.ascontiguousarray(x, "<u4"))))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], tokens: int = CAPACITY, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = NORM_WEIGHTS) -> np.ndarray:
    """Where the pieces of each length go, as rows (length, first rank, pieces, first sequence, pieces a sequence, offset).

    ``documents`` pieces and ``attention`` as the sum of squared lengths are
    the most a sequence may hold (by default as many as ``tokens`` allow).
    Takes lengths in falling order.  The number of rows depends on the number
    of lengths and the capacities, not on the number of pieces.
    """
    documents = documents or tokens
    attention = attention or tokens * tokens
    caps = np.array([tokens, documents, attention], float)
    seq, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    res = np.zeros((0, 3), np.int64)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > [tokens, documents, attention]).any():
            raise ValueError(f"a piece of length {length} fits no sequence")
        while left:
            fits = np.flatnonzero((res >= need).all(axis=1))
            if len(fits):
                gap = (res[fits] - need) / caps
                k = int(fits[np.argmin((gap * gap) @ np.array(weights))])
            else:
                each = int(min(tokens // length, documents, attention // (length * length)))
                bins = -(-left // each)
                seq, n = np.append(seq, opened), np.append(n, bins)
                res = np.vstack([res, [tokens, documents, attention]])
                opened += bins
                k = len(n) - 1
            each = int(min((res[k] // need).min(), left))
            bins = int(min(n[k], left // each))
            out.append((length, rank, bins * each, int(seq[k]), each, tokens - int(res[k, 0])))
            rank, left = rank + bins * each, left - bins * each
            if bins < n[k]:  # the rest stays as it is
                seq, n, res = np.append(seq, seq[k] + bins), np.append(n, n[k] - bins), np.vstack([res, res[k]])
                n[k] = bins
            res[k] = res[k] - each * need
        open_ = res[:, 0] > 0
        seq, n, res = seq[open_], n[open_], res[open_]
    return np.array(out, np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Add rank, from 0 within each length; a frequent length is ranked in parts."""
    spark, total = pieces.sparkSession, sum(counts.values())
    part = max(400, total // 10_000)
    salts = local_frame(spark, [(k, -(-c // part)) for k, c in counts.items()], "length long, salts long")  # a row for each length
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("rows"))
    base = sizes.select("length", "salt", (F.sum("rows").over(Window.partitionBy("length").orderBy("salt")) - F.col("rows")).alias("base"))
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    return local.join(small_side(base, len(counts) + total // part), ["length", "salt"]).withColumn("rank", F.col("local") + F.col("base"))


def _placer(places: np.ndarray):
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    key = (places[:, 0] << 44) + places[:, 1]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            p = places[np.searchsorted(key, (length << 44) + rank, "right") - 1] if len(length) else places[:0]
            k = rank - p[:, 1]
            each = np.maximum(p[:, 4], 1)
            yield pa.RecordBatch.from_arrays([*b.select(["doc_id", "piece", "start", "length", "ids_crc32"]).columns, pa.array(p[:, 3] + k // each), pa.array(p[:, 5] + k % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Null and empty texts are the id 0 alone.  Repeated rows are packed each on
    its own.  Extra columns are ignored; an empty table gives no rows.
    ``tokenizer`` is a file's path (by default the public word BPE).
    """
    pieces = materialize(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _cutter(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = plan(counts, capacity, documents, attention)
    out = ranked(pieces, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(_placer(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pieces of all documents, packed under all three constraints: a sequence has at most STAGE_DOCUMENTS pieces.

    Attention over a sequence is bounded by its tokens; pieces of one document of up to ``CAPACITY`` tokens have to fit,
    so no lower bound on it would hold.
    """
    return packed(docs, documents=STAGE_DOCUMENTS)
