"""Toxicity with a subsequence string-kernel support vector machine.

Two words are compared by the normalised gap-weighted subsequence kernel (Lodhi
et al. 2002), which tolerates gaps and inserted characters; what two chance
words share counts as nothing and what a word with an inserted letter keeps
counts whole.  A sentence is as like a landmark as the likest of its words.  Landmarks are words that
labelled toxic documents favour and some common ones; Nystrom features over
them (Williams and Seeger 2001) feed a linear support vector machine trained on
labelled sentences.  A document is judged by its worst sentence and its share
of bad ones.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, _cut_at_space, _words, crc_mod, mapped, materialize, row_ranges, table, text_buffer

#: Labelled documents used at most, those with the smallest hash of doc_id.
MAX_LABELLED = 8000
ORDER, DECAY = 3, 0.9
#: Normalised kernels up to the first count as 0 and from the second on as 1, with a straight line between.
CHANCE, WHOLE = 0.45, 0.6
TOXIC_LANDMARKS, COMMON_LANDMARKS, CUES = 48, 16, 2000
#: Log-likelihood ratio from which a word that toxic documents favour is a cue (Dunning 1993).
SURE = 20.0
WIDTH = 20
#: Letters of a word's stem.
STEM = 5
CACHE_WORDS = 400_000
WORDS_AT_ONCE = 1 << 15
_CODE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def letters(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _coded(words: list[str]) -> np.ndarray:
    return np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH) if words else np.zeros((0, WIDTH), np.uint32)


def subsequence_kernel(x: np.ndarray, y: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Unnormalised kernel of paired words, rows of letter codes filled up with 0."""
    n, width = x.shape
    lx, ly = int((x > 0).sum(1).max(initial=0)), int((y > 0).sum(1).max(initial=0))
    prime = np.ones((lx + 1, ly + 1, n), np.float32)  # K'_0 over all prefixes
    for k in range(order):
        total = np.zeros(n, np.float32)
        now = np.zeros((lx + 1, ly + 1, n), np.float32)
        for a in range(1, lx + 1):
            second = np.zeros(n, np.float32)  # K''
            ca = x[:, a - 1]
            for b in range(1, ly + 1):
                hit = (ca == y[:, b - 1]) & (ca > 0)
                gain = np.where(hit, np.float32(decay * decay) * prime[a - 1, b - 1], np.float32(0))
                total += gain
                second = np.float32(decay) * second + gain
                now[a, b] = np.float32(decay) * now[a - 1, b] + second
        prime = now
    return total


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.float32)
    for lo in range(0, len(x), 16384):
        out[lo : lo + 16384] = subsequence_kernel(x[lo : lo + 16384], y[lo : lo + 16384])
    return out


@functools.lru_cache(maxsize=None)
def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of ORDER letters in a word of a length, and their weights."""
    places = np.array(list(itertools.combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = [w[:WIDTH] for w in words]
        self.codes = _coded(self.words)
        self.own = _pairs(self.codes, self.codes)
        # each subsequence of the landmarks' letters with the landmarks that have it, by its number in their alphabet
        letters_ = np.unique(self.codes[self.codes > 0])
        self.base = len(letters_) + 1
        self.place = np.zeros(int(letters_.max(initial=0)) + 2, np.int32)
        self.place[letters_] = np.arange(1, self.base)
        rows = []
        for k, word in enumerate(self.words):
            places, weight = _subsequences(len(word))
            number, at = np.unique(self._numbers(self.codes[k : k + 1], places)[0], return_inverse=True)
            rows.append((number, np.full(len(number), k), np.bincount(at, weight, len(number))))
        number, self.of, self.weight = (np.concatenate(x) if rows else np.zeros(0, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * 3))
        order = np.argsort(number, kind="stable")
        self.of, self.weight = self.of[order], self.weight[order].astype(np.float32)
        self.first = np.searchsorted(number[order], np.arange(self.base**ORDER + 1)).astype(np.int32)

    def _numbers(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Number of every subsequence; one with a letter that no landmark has is nobody's."""
        x = self.place[np.minimum(codes, len(self.place) - 1)]
        out = x[:, places[:, 0]]
        for k in range(1, ORDER):
            out = out * self.base + x[:, places[:, k]]
        return out

    def similar(self, words: list[str]) -> np.ndarray:
        """Likeness of every word with every landmark, 0 to 1."""
        m = len(self.words)
        out = np.zeros((len(words), m), np.float32)
        if not m:
            return out
        lens = np.array([min(len(w), WIDTH) for w in words])
        codes = _coded(words)
        for length in range(ORDER, WIDTH + 1):
            places, weight = _subsequences(length)
            mine = np.flatnonzero(lens == length)
            step = max(1, (1 << 20) // len(places))
            for lo in range(0, len(mine), step):
                at = mine[lo : lo + step]
                number = self._numbers(codes[at], places)
                n = self.first[number + 1] - self.first[number]
                r, t = np.divmod(np.flatnonzero(n), n.shape[1])
                n = n[r, t]
                entry = np.repeat(self.first[number[r, t]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                kernel = np.bincount(np.repeat(r, n) * m + self.of[entry], np.repeat(weight[t], n) * self.weight[entry], len(at) * m).reshape(len(at), m)
                # a word's own kernel is at least the sum of its weights' squares
                w, k = np.nonzero(kernel > CHANCE * np.sqrt(float((weight * weight).sum()) * self.own) * (1 - 1e-5))
                some, back = np.unique(w, return_inverse=True)
                norm = _pairs(codes[at[some]], codes[at[some]])[back]
                out[at[w], k] = np.clip((kernel[w, k] / np.sqrt(norm * self.own[k]) - CHANCE) / (WHOLE - CHANCE), 0, 1)
        return out


def windows(word: str) -> list[str]:
    """A word of letters as overlapping windows of at most WIDTH letters, and its stem, which endings do not change."""
    whole = [word] if len(word) <= WIDTH else [word[k : k + WIDTH] for k in range(0, len(word) - WIDTH // 2, WIDTH // 2)]
    return whole + [word[:STEM]] if len(word) > STEM else whole


class Model:
    """Landmarks, their weights, the sentence bias and the document's logistic calibration."""

    def __init__(self, landmarks: Landmarks, alpha: np.ndarray, bias: float, logistic: np.ndarray):
        self.landmarks, self.alpha, self.bias, self.logistic = landmarks, alpha.astype(np.float64), bias, logistic
        self.clear()

    def clear(self) -> None:
        """Forget the likenesses of words seen."""
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.marks, self.likeness = np.zeros(0, np.int32), np.zeros(0, np.float32)

    def like(self, words: list[str]) -> np.ndarray:
        """Likeness of every word, long ones by their windows, with every landmark."""
        parts = [windows(letters(w)) for w in words]
        place = {p: k for k, p in enumerate(dict.fromkeys(p for ps in parts for p in ps))}
        found = self.landmarks.similar(list(place))
        out = found[[place[ps[0]] for ps in parts]]
        for k in range(1, max(map(len, parts), default=1)):
            rows = [r for r, ps in enumerate(parts) if len(ps) > k]
            out[rows] = np.maximum(out[rows], found[[place[parts[r][k]] for r in rows]])
        return out

    def _cached(self, h: np.ndarray, part: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (word, landmark, likeness) of words with any likeness."""
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_WORDS:
            self.clear()
        where = np.searchsorted(self.hash, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.hash):
            known = self.hash[np.minimum(where, len(self.hash) - 1)] == uniq
        if not known.all():
            raw, at = part.tobytes(), first[~known]
            for lo in range(0, len(at), WORDS_AT_ONCE):
                a = at[lo : lo + WORDS_AT_ONCE]
                found = self.like([raw[x:y].decode("utf-8", "replace") for x, y in zip(s[a].tolist(), e[a].tolist(), strict=True)])
                r, c = np.nonzero(found)
                n = np.bincount(r, minlength=len(a))
                fresh, order = uniq[~known][lo : lo + WORDS_AT_ONCE], np.cumsum(n) - n
                to = np.searchsorted(self.hash, fresh)
                self.at, self.n = np.insert(self.at, to, len(self.marks) + order), np.insert(self.n, to, n)
                self.hash = np.insert(self.hash, to, fresh)
                self.marks, self.likeness = np.append(self.marks, c.astype(np.int32)), np.append(self.likeness, found[r, c])
            where = np.searchsorted(self.hash, uniq)
        at, n = self.at[where][inv], self.n[where][inv]
        word = np.repeat(np.arange(len(h)), n)
        place = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(word))
        return word, self.marks[place], self.likeness[place]

    def _read(self, part: np.ndarray, off: np.ndarray):
        """Start and end of each word and the entries of words; of a long text, piece by piece between words."""
        pieces = _cut_at_space(part) if len(part) > 2 * CHUNK_BYTES else [part]
        found, at, words = [], 0, 0
        for p in pieces:
            with np.errstate(over="ignore"):
                h, s, e = _words(p, off if len(p) == len(part) else np.array([0, len(p)]), _CODE)
            if len(h):
                word, mark, likeness = self._cached(h, p, s, e)
                found.append((s + at, e + at, word + words, mark, likeness))
                words += len(h)
            at += len(p)
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _range(self, part: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Worst sentence and share of sentences above 0 of each row."""
        out = np.tile(np.array([self.bias, 0.0]), (len(off) - 1, 1))
        s, e, word, mark, likeness = self._read(part, off)
        if not len(s) or not len(self.alpha):
            return out
        bounds = np.searchsorted(s, off)
        lines = np.flatnonzero(part == 10)
        start = np.zeros(len(s), bool)
        start[1:] = _STOP[part[e[:-1] - 1]] | (np.searchsorted(lines, s[1:]) > np.searchsorted(lines, e[:-1]))
        start[bounds[:-1][bounds[:-1] < len(s)]] = True
        # letters spelt one by one count as a word, at its first letter
        single = (e - s == 1) & ~_STOP[part[s]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= 3:
                found = self.like([part[s[a:b]].tobytes().decode("utf-8", "replace")])[0]
                c = np.flatnonzero(found)
                word, mark, likeness = np.append(word, np.full(len(c), a)), np.append(mark, c), np.append(likeness, found[c])
        at = np.flatnonzero(start)
        f = np.full(len(at), self.bias)
        # the likest word of a sentence, for each landmark
        cell = (np.searchsorted(at, word, "right") - 1) * len(self.alpha) + mark
        order = np.lexsort((likeness, cell))
        last = order[np.concatenate([cell[order][1:] != cell[order][:-1], [True]])] if len(order) else order
        np.add.at(f, cell[last] // len(self.alpha), likeness[last] * self.alpha[cell[last] % len(self.alpha)])
        some = np.flatnonzero(np.diff(bounds))
        first = np.searchsorted(at, bounds[some])
        out[some, 0] = np.maximum.reduceat(f, first)
        ends = np.searchsorted(at, bounds[some + 1])
        out[some, 1] = np.add.reduceat((f > 0).astype(float), first) / (ends - first)
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(texts)
        out = np.zeros((len(offsets) - 1, 2))
        for lo, hi in row_ranges(offsets):
            part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            out[lo:hi] = self._range(part, off)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = self.features(texts)
        z = np.clip(x @ self.logistic[1:] + self.logistic[0], -35, 35)
        return np.round(1 / (1 + np.exp(-z)), 9)


def _sentences(text: str) -> list[list[str]]:
    import re

    return [s.split() for s in re.split(r"(?<=[.!?])[ \t\r\f\v]+|\n+", text) if s.strip()]


def _parts(word: str) -> tuple[str, str]:
    """A word as cues have it: whole and as its stem."""
    word = letters(word)
    return word[:WIDTH], word[:STEM]


def _examples(cues: dict[str, float], marks: Landmarks):
    """Sentences of labelled documents, as their likest words' likenesses.

    Of a toxic document the first sentence with each cue that is a landmark, of a clean one the most suspicious and the
    middle one.
    """
    named = set(marks.words) & set(cues)
    model = Model(marks, np.zeros(len(marks.words)), 0.0, np.zeros(3))

    def likest(sentences):
        place = {w: k for k, w in enumerate(dict.fromkeys(w for s in sentences for w in s))}
        found = model.like(list(place))
        return [found[[place[w] for w in s]].max(0).astype(np.float64).tolist() for s in sentences]

    def chosen(label, found):
        weight = [sum(max((cues.get(p, 0.0) for p in ps), default=0.0) for ps in map(_parts, s)) for s in found]
        if label == 0:
            return [found[int(np.argmax(weight))], found[len(found) // 2]]
        first: dict[str, int] = {}
        for k, sentence in enumerate(found):
            if weight[k] > 0:
                for w in sentence:
                    for p in _parts(w):
                        if p in named:
                            first.setdefault(p, k)
        return [found[k] for k in sorted(set(first.values()))]

    def run(batches):
        for b in batches:
            rows = []
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = _sentences(text or "")
                if found:
                    rows += [(label, s) for s in chosen(label, found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(likest([r[1] for r in rows]), pa.list_(pa.float64()))], ["label", "likest"])

    return run


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 1500, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes, by accelerated gradient descent."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y != 1).sum(), 1))
    z = np.hstack([x, np.ones((len(x), 1))])
    step = 1.0 / (2 * float((cost[:, None] * z * z).sum()) + reg)
    w = v = np.zeros(z.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (z @ v))
        grad = -2 * (cost * sign * slack) @ z + reg * np.append(v[:-1], 0.0)
        new = v - step * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (p - y) + 1e-2 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return w


def _apart(words: list[str], most: int) -> list[str]:
    """The first ``most`` words, without those that count wholly as one before."""
    like = Landmarks(words[: 8 * most]).similar(words[: 8 * most])
    out: list[int] = []
    for k in range(len(like)):
        if len(out) < most and not (like[k, out] >= 1).any():
            out.append(k)
    return [words[k] for k in out]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most ``max_labelled`` labelled documents of docs.

    The driver gets the words of that sample with the most weight, one number a
    landmark of each example sentence and two numbers a document.  Without both classes every document
    scores the share of toxic labels, or 0 where there are none.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(materialize(picked)), F.col("doc_id").cast("long") == F.col("id")).select("id", "text", F.col("label").cast("int").alias("label")))
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = seen.get(1, 0), seen.get(0, 0)
    if not bad or not good:
        prior = 30.0 if bad else -30.0
        return Model(Landmarks([]), np.zeros(0), 0.0, np.array([prior, 0.0, 0.0]))
    word = F.regexp_replace(F.lower("word"), r"[^\p{L}]", "")
    words = sample.select("id", "label", F.explode(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+"))).alias("word")).select("id", "label", word.alias("word")).filter("word <> ''")
    words = words.select("id", "label", F.explode(F.array(F.left("word", F.lit(WIDTH)), F.left("word", F.lit(STEM)))).alias("word")).distinct()
    counted = words.groupBy("word").agg(F.sum("label").alias("t"), F.count_if(F.col("label") == 0).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    expected = (F.col("t") + F.col("c")) / float(bad + good)
    ratio = 2 * (F.col("t") * F.log(F.greatest(F.col("t"), F.lit(1)) / (expected * bad)) + F.col("c") * F.log(F.greatest(F.col("c"), F.lit(1)) / (expected * good)))
    counted = materialize(counted.filter("t > 0").withColumn("weight", F.col("t") * odds))
    cues = counted.filter((odds > 0) & (ratio >= SURE)).orderBy(F.col("weight").desc(), "word").limit(CUES).collect()
    common = counted.filter((F.col("t") > 0) & (F.abs(odds) < 1.0)).orderBy(F.col("c").desc(), "word").limit(COMMON_LANDMARKS).collect()
    strong = _apart([r["word"] for r in cues if len(r["word"]) >= ORDER], TOXIC_LANDMARKS)
    marks = Landmarks(strong + [r["word"] for r in common if len(r["word"]) >= ORDER])
    if not marks.words:
        return Model(marks, np.zeros(0), 0.0, np.array([np.log(bad / good), 0.0, 0.0]))
    examples = mapped(sample, _examples({r["word"]: float(r["weight"]) for r in cues}, marks), "label int, likest array<double>").collect()
    x = np.array([e["likest"] for e in examples]).reshape(len(examples), len(marks.words))
    values, vectors = np.linalg.eigh(marks.similar(marks.words).astype(np.float64))
    half = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T  # inverse root of the landmarks' kernel
    w, bias = _svm(x @ half, np.array([e["label"] for e in examples]))
    model = Model(marks, half @ w, bias, np.zeros(3))

    def measured(batches):
        for b in batches:
            f = model.features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(f[:, 0]), pa.array(f[:, 1])], ["label", "worst", "share"])

    got = mapped(sample, measured, "label int, worst double, share double").collect()  # max_labelled rows at most
    f = np.array([(r["worst"], r["share"]) for r in got])
    model.logistic = _logistic(f, np.array([float(r["label"]) for r in got]))
    model.clear()
    return model


def scored(docs: DataFrame, labels: DataFrame, held_out, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Learns from labelled rows that are not held out.  Null and empty texts
    score as a text without a bad sentence.  Rows with equal text score alike.
    A null doc_id is not held out.  Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(rows.filter("not held_out"), labels, max_labelled)

    def run(batches):
        for b in batches:
            p = model.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) == 0)


def stage(spark, docs, sf_dir):
    """Documents not predicted toxic, in the columns of docs."""
    names = docs.columns
    model = train(docs.filter(~F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))), table(spark, sf_dir, "labels"))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column("text")) < 0.5)).select(names)

    return mapped(docs, run, docs.schema)
