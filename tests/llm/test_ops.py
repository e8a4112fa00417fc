import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import common, op1_mixing, op2_quality, op3_language, op4_topk, op5_packing, op6_fingerprints, op7_licenses, op8_warc, op9_jaccard, op10_toxicity

LONG = "word " * 60_000
TEXTS = ["the cat sat on the mat and then it ran off", None, "", "   \t\n", "one two", "Ärger über große Straßen 数字 12 it's <|x|>", LONG,
         "the cat sat on the mat and then it ran off", "You idiot. This is fine.", "a b c d e f g h i j k l m n o p", "A B C D E F G H I J K L M N O P q"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], None if i == 4 else f"s{i % 3}", len(t or ""), 1.0, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, size int").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 3), int(i == 8)) for i in range(11)], "doc_id long, quality int, toxic int")


def words(t):
    out, cur = [], ""
    for c in t or "":
        if c in " \t\n\v\f\r":
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + [cur] * bool(cur)


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_mixing(spark, docs):
    rows = op1_mixing.mixed(docs).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id: r.size for r in rows} == {i: len(words(t)) for i, t in enumerate(TEXTS)}
    assert all(r.taken <= 3 * r.size for r in rows) and all(r.taken % r.size == 0 for r in rows if r.size)
    assert sum({r.source_size: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(tuple, op1_mixing.mixed(docs).collect())) == sorted(map(tuple, rows))
    assert op1_mixing.mixed(docs.limit(0)).count() == 0
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in rows}
    out = op1_mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and out.groupBy("doc_id").count().collect() and {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}


def test_cuts_with_ties(spark):
    items = spark.createDataFrame([("a", 5, 10)] * 50 + [("a", 6, 1), (None, 7, 3)], "grp string, key long, weight long")
    budgets = spark.createDataFrame([("a", 400.0), (None, 100.0)], "grp string, budget double")
    got = {r.grp: r.cut for r in common.nested_cuts(items, budgets, 2).collect()}
    assert got["a"] == 5 and got[None] >= 7  # 500 is nearer to 400 than 0


def quality_by_hand(rows, labels, gumbels):
    """doc_id and key of every document taken, from n-grams one after the other."""
    m = op2_quality

    def grams(text):
        raw = [x + 1 for x in (text or "").encode()]
        out = []
        for k in range(len(raw) - m.GRAM + 1):
            h = 0
            for x, f in zip(raw[k : k + m.GRAM], m._FACTORS.tolist(), strict=True):
                h = (h * 31 + x * f) % 2**32
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D % 2**32) >> (32 - m.BUCKET_BITS))
        return out

    side = lambda i: zlib.crc32(str(i).encode()) % 2
    found = {i: grams(t) for i, t in rows}
    raw, good = defaultdict(int), defaultdict(int)
    for i, gs in found.items():
        for g in gs:
            raw[g] += 1
            good[g] += labels.get(i) == 1 and side(i) == 0
    n_raw, n_good, size = sum(raw.values()), sum(good.values()), 2**m.BUCKET_BITS
    ratio = {g: np.log((good[g] + m.SHRINK) / (n_good + m.SHRINK * size)) - np.log((raw[g] * n_good / n_raw + m.SHRINK) / (n_good + m.SHRINK * size)) for g in raw}
    mean = {i: sum(ratio[g] for g in gs) / max(len(gs), 1) for i, gs in found.items()}
    held = sorted((mean[i], labels[i]) for i in found if i in labels and side(i) == 1 and found[i])
    cuts = [held[0][0] - 1] + [x for x, _ in held] + [held[-1][0] + 1]
    best = []
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        at = (a + b) / 2
        best.append((at, np.mean([x < at for x, y in held if y == 0]) + np.mean([x >= at for x, y in held if y == 1])))
    level = next(at for at, gain in best if gain >= max(g for _, g in best) - 0.02)
    k = sum(not found[i] or mean[i] >= level for i in found)
    keys = {i: min(len(found[i]), m.EVIDENCE) * mean[i] + gumbels[i] for i in found}
    return {i: keys[i] for i in sorted(keys, key=lambda i: -keys[i])[:k]}


@pytest.fixture(scope="module")
def mixed_quality(spark):
    rng = np.random.default_rng(4)
    good, bad = [f"word{k} " for k in range(40)], [f"#{k}%!{k * 7} " for k in range(40)]
    rows = []
    for i in range(160):
        share = (i % 8) / 7
        rows.append((i, "".join(rng.choice(good if rng.random() < share else bad) for _ in range(int(rng.integers(1, 60))))))
    rows += [(500, None), (501, ""), (502, "ab")]
    labels = {i: int(i % 8 > 3) for i in range(0, 160, 2)} | {500: 0}
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")


def test_quality_against_brute_force(spark, mixed_quality):
    rows, labels, docs, frame = mixed_quality
    taken = []
    for seed in (1, 2, 3):
        gumbels = {r.doc_id: r.g for r in docs.select("doc_id", op2_quality.gumbel(F.col("doc_id"), seed).alias("g")).collect()}
        want = quality_by_hand(rows, labels, gumbels)
        got = {r.doc_id: r.gumbel_key for r in op2_quality.resampled(docs, frame, seed=seed).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-4) for i in got)
        taken.append(frozenset(got))
    assert len(set(taken)) > 1 and len({len(t) for t in taken}) == 1  # the Gumbel numbers decide near the level
    assert len(frozenset.intersection(*taken)) > 0.8 * len(taken[0])


def test_quality_models_are_distributions():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 50, 1 << 10).astype(float)
    for good in (np.floor(raw * rng.random(1 << 10)), np.zeros(1 << 10)):
        for logs in op2_quality.models(raw, good):
            assert np.exp(logs).sum() == pytest.approx(1.0)


def test_quality_cases(spark, docs, labels, mixed_quality, tmp_path):
    assert op2_quality.resampled(docs, labels.limit(0)).count() == len(TEXTS)
    assert op2_quality.resampled(docs.limit(0), labels).count() == 0
    _, _, some, frame = mixed_quality
    frame.write.parquet(str(tmp_path / "labels.parquet"))
    named = some.selectExpr("doc_id", "text", "'x' as gumbel", "1 as _gumbel", "2 as label", "3 as grams")
    out = op2_quality.stage(spark, named, str(tmp_path))
    assert out.columns == named.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in op2_quality.resampled(some, frame).collect())
    twice = op2_quality.resampled(some.union(some), frame).groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}
    assert op2_quality.stage(spark, named.limit(0), str(tmp_path)).count() == 0


def bundle(text):
    """A text's bundle, one trigram after the other; what is no letter is a gap, and several gaps are one."""
    z = [0]
    for c in (text or "").lower():
        k = ord(c) if c.isalpha() else 0
        if k or z[-1]:
            z.append(k)
    z = z + [0] if z[-1] else z
    out = np.zeros(op3_language.DIM, int)
    for tri in zip(z, z[1:], z[2:]):  # noqa: B905
        if any(tri):
            v = [op3_language.letter_vector(c).astype(int) for c in tri]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def test_language_vectors(monkeypatch):
    texts = ["ab", None, "..", "Ärger über große Straßen", "数字 und 文字", "a1b  c", ""]
    got = op3_language.document_vectors(texts)
    for t, v in zip(texts, got, strict=True):
        assert (v == bundle(t)).all()
    long = op3_language.document_vectors(["abba " * 200_000])[0]  # cut into pieces between words
    assert (long == bundle("abba " * 20) + (200_000 - 20) * (bundle("abba " * 21) - bundle("abba " * 20))).all()
    monkeypatch.setattr(op3_language, "CHUNK_CHARS", 16)
    for t in ["the cat, the dog -- and the bird sat on a mat", "x" * 50, "1234567890" * 9, "ab" + "-" * 40 + "cd" + " " * 30, "aİb İc" * 9]:
        assert (op3_language.document_vectors([t])[0] == bundle(t)).all()
    # letters that differ have vectors of their own
    assert not (op3_language.letter_vector(0x4E00) == op3_language.letter_vector(0x4E00 + 4093)).all()


def test_language_against_brute_force(spark, docs):
    rows = [r.asDict() for r in docs.collect() if r.text != LONG]
    frame = spark.createDataFrame(rows, docs.schema)
    total = {}
    for r in rows:
        if r["lang"] is not None and r["doc_id"] % 4:
            total[r["lang"]] = total.get(r["lang"], 0) + bundle(r["text"])
    langs = sorted(total)
    got = {r.doc_id: r for r in op3_language.identified(frame, F.col("doc_id") % 4 == 0).collect()}
    for r in rows:
        v = bundle(r["text"])
        if not v.any():
            assert (got[r["doc_id"]].lang_pred, got[r["doc_id"]].score) == ("und", 0.0)
            continue
        cos = [float(v @ total[x] / np.linalg.norm(v) / np.linalg.norm(total[x])) for x in langs]
        assert got[r["doc_id"]].lang_pred == langs[int(np.argmax(cos))] and got[r["doc_id"]].score == pytest.approx((1 + max(cos)) / 2, abs=1e-6)
        assert got[r["doc_id"]].held_out == (r["doc_id"] % 4 == 0)
    assert {r.lang_pred for r in op3_language.identified(frame.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}
    assert op3_language.identified(frame.limit(0), F.lit(False)).count() == 0
    # equal cosines go to the smaller language
    tied = spark.createDataFrame([(1, "same words", "fr"), (2, "same words", "de"), (3, "same words", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in op3_language.identified(tied, F.lit(False)).collect()} == {"de"}


def topk_by_hand(vecs):
    """Every query's list, by its id and vector."""
    q = [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [(i, v) for i, v in q if sum((abs(x) + 1) ** 2 for x in v) < 2**62]
    out = []
    for i, a in {(i, v) for i, v in q if i % 20 == 0}:
        scored = sorted(((sum(x * y for x, y in zip(a, v)), k) for k, v in q if k != i), key=lambda x: (-x[0], x[1]))[:20]  # noqa: B905
        out += [(i, r, k, score) for r, (score, k) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("part,block", [(100_000, 256), (16, 4)])
def test_topk(spark, monkeypatch, part, block):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    vecs += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(300, None), (301, [float("nan")] * 4), (302, [1.0, None, 0.0, 0.0]), (40, [9.0, 9.0, 9.0, 9.0])]
    vecs += [(60, vecs[60][1]), (7, vecs[7][1]), (None, [1.0] * 4), (320, [1.0]), (340, [float("inf"), 0.0, 0.0, 0.0]), (360, [1e30, 0.0, 0.0, 0.0]), (380, [])]
    for name, v in (("PART_ROWS", part), ("BLOCK", block), ("SAMPLE", 32), ("PIVOTS", 5)):
        monkeypatch.setattr(op4_topk, name, v)
    df = spark.createDataFrame([(i, v, "x", 3, 0.1) for i, v in vecs], "vec_id long, embedding array<float>, part string, query int, dist double").repartition(3)
    got = sorted(map(tuple, op4_topk.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == topk_by_hand(vecs)
    assert op4_topk.top_k(df.limit(0), F.lit(True)).count() == 0 and op4_topk.top_k(df, F.lit(False)).count() == 0


def test_topk_of_large_components(spark):
    """Scores beyond 2**53 stay exact."""
    rng = np.random.default_rng(2)
    vecs = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 1e6]) for i in range(90)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, op4_topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == topk_by_hand(vecs)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = op5_packing.packed(docs).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by[i], key=lambda r: r.piece)] == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == -(-sum(r.length for r in rows) // 2048)
    assert op5_packing.packed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("documents,attention", [(None, None), (3, None), (None, 500)])
def test_plan_keeps_every_constraint(documents, attention):
    counts = {1: 1000, 3: 77, 7: 50, 12: 9, 20: 5}
    used = defaultdict(list)
    for length, rank, n, seq, each, offset in op5_packing.plan(counts, 20, documents, attention).tolist():
        for k in range(n):
            used[seq + k // each].append((offset + k % each * length, length))
        counts[length] -= n
    assert not any(counts.values())
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 20 and len(pieces) <= (documents or 20) and sum(n * n for _, n in pieces) <= (attention or 400)


def test_packing_of_repeated_rows_and_stage(spark):
    rows = [(1, "a few words here", "x", 0)] * 3 + [(None, "other words", "y", 1), (2, None, "z", 2)] + [(k, "hi", "t", 3) for k in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, length int").repartition(4)
    out = op5_packing.packed(docs).collect()
    assert len(out) == len(rows) and len({(r.sequence_id, r.offset) for r in out}) == len(rows) and len({r.sequence_id for r in out}) == 1
    assert len({r.ids_crc32 for r in out if r.doc_id == 1}) == 1
    staged = defaultdict(list)
    for r in op5_packing.stage(spark, docs, "").collect():
        staged[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, staged.values())) == len(rows) and max(map(len, staged.values())) == op5_packing.STAGE_DOCUMENTS and len(staged) == -(-len(rows) // op5_packing.STAGE_DOCUMENTS)
    for pieces in staged.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(pieces), sorted(pieces)[1:]))  # noqa: B905


@pytest.mark.parametrize("part_docs", [2000, 3])
def test_fingerprints_of_repeated_and_null_ids(spark, monkeypatch, part_docs):
    """Many parts, and rows that share an id, against the order by falling doc_id and text."""
    monkeypatch.setattr(op6_fingerprints, "PART_DOCS", part_docs)
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(20)) if rng.random() < 0.9 else None, " ".join(f"w{x}" for x in rng.integers(0, 9, int(rng.integers(0, 12)))) or None) for _ in range(60)]
    got = op6_fingerprints.compared(spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, k int, part string").repartition(7)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        changed = op6_fingerprints.edited(a, b)
        x, y, z = shingles(a), shingles(b), shingles(changed)
        near = [len(x & o) / len(x | o) if x | o else 1.0 for o in (z, y)]
        want.append((i, len(a), hashlib.sha256(changed.encode()).hexdigest(), *[round(v, 9) for v in near]))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(want, key=str)


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in op6_fingerprints.compared(docs).collect()}
    assert len(rows) == len(TEXTS)
    order = sorted(range(len(TEXTS)), reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        a, b = TEXTS[i] or "", TEXTS[j] or ""
        m = len(a) // 3
        assert rows[i].n_chars == len(a) and rows[i].edited_sha256 == hashlib.sha256((a[: len(a) - m] + b[:m]).encode()).hexdigest()
        x, y = shingles(a), shingles(b)
        if len(x | y) <= op6_fingerprints.K:  # small sets: exact
            assert rows[i].near_next == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
            assert op6_fingerprints.distinct(op6_fingerprints.decode(rows[i].fingerprint)) == len(x)
    assert rows[0].fingerprint == rows[7].fingerprint and op6_fingerprints.compared(docs.limit(0)).count() == 0
    a, b = (op6_fingerprints.decode(rows[i].fingerprint) for i in (0, 9))
    assert op6_fingerprints.containment(a, op6_fingerprints.merge(a, b)) == pytest.approx(1.0)


def test_licenses(spark):
    text = "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. x"
    rows = [(1, text), (2, "Released under the MIT License."), (3, None), (4, ""), (2, "Released under the MIT License."), (None, "SPDX-License-Identifier: GPL-2.0-only\n"), (5, ("plain words. " * 50_000) + text)]
    df = spark.createDataFrame([(i, t, "x", 1, "l") for i, t in rows], "doc_id long, text string, rest string, ids int, licenses string")
    got = [(r.doc_id, r.licenses, r.unmatched) for r in op7_licenses.scanned(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "Apache-2.0", 0), (2, "MIT", 0), (3, "", 0), (4, "", 0), (2, "MIT", 0), (None, "GPL-2.0-only", 0), (5, "Apache-2.0", 0)], key=str)
    assert op7_licenses.scanned(df.limit(0)).count() == 0
    assert all(any(m in s for m in op7_licenses.MARKS) for s in op7_licenses.KNOWN) and all(i in op7_licenses.KNOWN.values() for _, ids in op7_licenses.ALL_RULES for i in ids)
    assert [r for r in op7_licenses.ALL_RULES if r in op7_licenses.RULES] == op7_licenses.RULES


def test_whole_licenses(spark):
    """Published texts, wrapped, in comments, in one line."""
    mit = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    bsd = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
    third = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
    unlicense = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
    boost = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)
"""
    epl = """This program and the accompanying materials are made available under
the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
    known = [(mit, "MIT"), (bsd.format(""), "BSD-2-Clause"), (bsd.format(third), "BSD-3-Clause"), (isc, "ISC"), (unlicense, "Unlicense"), (boost, "BSL-1.0"), (epl, "EPL-2.0"), ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0")]
    forms = [lambda t: t, lambda t: "".join(f" * {x}\n" for x in t.splitlines()), lambda t: "".join(f"# {x}\r\n" for x in t.splitlines()), lambda t: " ".join(t.split())]
    rows = [(f(t), name) for t, name in known for f in (forms if "SPDX" not in t else forms[:3])]
    got = op7_licenses.scanned(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.unmatched) for r in got} == {k: (name, 0) for k, (_, name) in enumerate(rows)}


def test_licenses_of_wrapped_notices(spark):
    gpl = """ * This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program{} write to the Foundation.
"""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:\r
\r
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    third = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    texts = [(gpl.format(":", ",", 3, ".  If not,"), "GPL-3.0-or-later"), (gpl.format(";", ";", 2, "; if not,"), "GPL-2.0-or-later"), (apache, "Apache-2.0"), (mit, "MIT"), (mpl, "MPL-2.0"), (bsd, "BSD-2-Clause"),
             (bsd + third.format("the copyright holder"), "BSD-3-Clause"), (" ".join((bsd + third.format("Example | Inc. & Sons")).split()), "BSD-3-Clause"), (bsd + "\n" + mpl, "BSD-2-Clause,MPL-2.0")]
    got = op7_licenses.scanned(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.unmatched) for r in got} == {k: (name, 0) for k, (_, name) in enumerate(texts)}


def test_warc(spark):
    html = ["<p>é</p>" * 50, "", None, "<p>é</p>" * 50, "x" * 300_000] + [f"<b>{i}</b>" * 30 for i in range(30)]
    df = spark.createDataFrame([(i, f"http://a/{i}" if i else None, h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    rows = {r.page_id: r for r in op8_warc.archived(df).collect()}
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        r, f = rows[i], first.setdefault(raw, i)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if f == i else ("revisit", f)) and (r.record_type == "revisit" or bytes(r.payload) == raw)
    assert op8_warc.archived(df.limit(0)).count() == 0
    again = [(None, "a", "null id"), (3, "b", "same"), (3, "c", "same"), (5, "d", "same"), (None, "e", "null id")]
    got = op8_warc.archived(spark.createDataFrame([(i, u, h, "x") for i, u, h in again], "page_id long, url string, html string, sha string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([(None, "response", None)] * 2 + [(3, "response", None)] * 2 + [(5, "revisit", 3)], key=str)
    w = op8_warc.ArchiveWriter(b"")
    good = w.lead + w.frame(op8_warc.record("response", "urn:page:1", "u", b"hi", op8_warc.digest(b"hi"), 2))
    assert [h["warc-type"] for h, _ in op8_warc.read_archive(good)] == ["response"]
    for bad in (good[:-3], good + b"a", good + b"abc", good + b"\x50\x2a\x4d\x18\xff\x00\x00\x00", w.lead + w.frame(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx\r\n\r\n"), w.lead + w.frame(b"no")):
        with pytest.raises(op8_warc.WarcError):
            list(op8_warc.read_archive(bad))


def expected_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_against_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(4)]
    texts = list(TEXTS)
    for b in base:
        for k in range(25):
            w = b.split()
            for at in rng.choice(len(w), k % 6, replace=False):
                w[at] = f"n{rng.integers(1000)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9_jaccard.linked(df).collect()} == expected_components(texts)
    assert op9_jaccard.linked(df.limit(0)).count() == 0


def test_jaccard_with_repeated_rows(spark):
    def text(k, last):
        return " ".join([*(f"p{k}w{i}" for i in range(60)), last])

    texts = [text(k, f"end{k}{j}") for k in range(6) for j in range(2)]
    want = expected_components(texts)
    assert all(want[2 * k + 1][1] == 2 * k for k in range(6))
    rows = list(enumerate(texts))
    for repeats in (rows * 2, rows + rows[::2], rows * 3 + rows[:5]):
        got = op9_jaccard.linked(spark.createDataFrame(repeats, "doc_id long, text string")).collect()
        assert len(got) == len(repeats)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def near_copies(n, seed=5):
    """Copies of one text with one or two changes: groups of many, with pairs on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base, texts = [f"w{k}" for k in range(100)], []
    for k in range(n):
        w = list(base)
        at = rng.integers(0, 30) * 3
        for e in range(1 + (k % 8 > 0)):
            w[at + 6 * e] = f"n{rng.integers(6)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("block,split,partners", [(512, 1024, 64), (512, 1024, 1), (8, 24, 64), (8, 24, 1)])
def test_jaccard_large_groups(spark, monkeypatch, block, split, partners):
    """Groups over many partitions; small limits make it put pairs off and cut groups into blocks."""
    texts = near_copies(160)
    limits, plain = [], op9_jaccard._tree_pairs
    monkeypatch.setattr(op9_jaccard, "_tree_pairs", lambda limit: limits.append(limit) or plain(limit))
    for name, v in (("BLOCK", block), ("SPLIT", split), ("PARTNERS", partners)):
        monkeypatch.setattr(op9_jaccard, name, v)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9_jaccard.linked(df).collect()} == expected_components(texts)
    assert limits[0] == partners and (len(limits) > 1) == (partners == 1)


@pytest.mark.parametrize("rows", [0, 40])
def test_jaccard_links_and_pairs_of_the_driver(spark, monkeypatch, rows):
    """Tables, the driver, and both in turn give the same components; cut groups and put-off pairs among them."""
    texts = near_copies(60, 11) + [" ".join(f"v{k}x{i}" for i in range(30)) for k in range(4) for _ in range(2)]
    for name, v in (("LOCAL_ROWS", rows), ("BLOCK", 8), ("SPLIT", 24), ("PARTNERS", 2)):
        monkeypatch.setattr(op9_jaccard, name, v, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9_jaccard.linked(df).collect()} == expected_components(texts)


def test_jaccard_few_rows_take_few_shuffles(spark):
    """A shuffle costs a task for every partition, however few its links and pairs."""
    texts, sc = near_copies(160), spark.sparkContext
    df = common.materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, ("37", "false"), strict=True):
            spark.conf.set(k, v)
        sc.setJobGroup("few", "few")
        op9_jaccard.linked(df).collect()
        seen = [sc.statusTracker().getStageInfo(k) for j in sc.statusTracker().getJobIdsForGroup("few") for k in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in zip(names, old, strict=True):
            spark.conf.set(k, v)
    whole = sum(s is not None and s.numTasks == s.numCompletedTasks == 37 for s in seen)
    assert 0 < whole <= 30


def test_jaccard_nodes_keep_every_pair():
    """The traversal of blocks' nodes and members leaves open every pair that links."""
    texts = near_copies(90, 7)
    sets = list(common.shingle_sets(__import__("pyarrow").array(texts)))
    sizes = np.array([len(x) for x in sets])
    sigs = [op9_jaccard.signature(x) for x in sets]
    found = {(min(a, b), max(a, b)) for i, j in op9_jaccard._by_class(sizes, sigs, np.arange(len(sets))) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    links = {(a, b) for b in range(len(sets)) for a in range(b) if op9_jaccard.enough(common.shared(sets[a], sets[b]), sizes[a], sizes[b])}
    assert links and links <= found
    import pyarrow as pa

    rows = [(k // 10, 0, int(n), s.tobytes(), k) for k, (n, s) in enumerate(zip(sizes, sigs, strict=True))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["work", "token", "n", "sig", "comp"])
    nodes = pa.Table.from_batches(list(op9_jaccard._block_nodes([batch]))).combine_chunks().to_batches()
    open_ = {(x, y) for b in op9_jaccard._block_pairs(nodes) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)}
    open_ |= {(y, x) for x, y in open_} | {(k, k) for k in range(9)}
    assert all((a // 10, b // 10) in open_ for a, b in links)


def test_jaccard_group_stream():
    """Prefix rows in any batches give the groups of two and more; large groups pass through."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted({(int(rng.integers(40)), int(rng.integers(30))) for _ in range(200)} | {(99, d) for d in range(80)})
    want = {(t, d) for t, d in rows if sum(t == x for x, _ in rows) > 1}
    twice = sorted(rows + rows[::3])
    for size in (1, 7, 64, 1000):
        for held in (10, 500):
            old, op9_jaccard.HELD_ROWS = op9_jaccard.HELD_ROWS, held
            try:
                parts = [twice[k : k + size] for k in range(0, len(twice), size)]
                batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p], pa.int64()), pa.array([r[1] for r in p], pa.int64()), pa.array([5] * len(p), pa.int64())], ["token", "doc", "n"]) for p in parts]
                got = [tuple(r.values()) for b in op9_jaccard._grouped(batches) for r in b.to_pylist()]
            finally:
                op9_jaccard.HELD_ROWS = old
            assert {(g[0], g[1]) for g in got} == want and len(got) == len(want)
            assert {g[3] for g in got if g[0] == 99} == {min(80, held + 1)}
    same = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([3, 3, 7, 7, 4, 4], [1, 2, 1, 2, 1, 3], [5] * 6, [2] * 6, [8, 8, 8, 8, 9, 9])], op9_jaccard.GROUPS)
    for cut in range(7):
        got = [r["token"] for b in op9_jaccard._once_each([same.slice(0, cut), same.slice(cut)]) for r in b.to_pylist()]
        assert got == [3, 3, 4, 4]


def test_jaccard_with_repeated_ids(spark):
    """Rows that share a doc_id are one document, with the links of all its texts."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (4, b), (5, a), (5, b), (6, c), (7, None), (5, ""), (None, a), (8, b + " z")]
    got = op9_jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(3, 36, 3), (4, 36, 3), (5, 36, 3), (5, 36, 3), (6, 36, 6), (7, 0, 7), (5, 0, 3), (None, 36, None), (8, 37, 3)], key=str)
    rng = np.random.default_rng(8)
    texts = near_copies(30, 9) + [" ".join(f"x{x}" for x in rng.integers(0, 9, 12)) for _ in range(10)]
    rows = [(int(rng.integers(25)), texts[int(rng.integers(len(texts)))]) for _ in range(60)]
    sets, root = [shingles(t) for _, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(rows)):
        for q in range(p):
            if 100 * len(sets[p] & sets[q]) >= 75 * len(sets[p] | sets[q]):
                x, y = find(rows[p][0]), find(rows[q][0])
                root[max(x, y)] = min(x, y)
    got = op9_jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


def test_jaccard_stage(spark):
    texts = near_copies(12, 4)
    rows = [(i, t, "x", i, 1) for i, t in enumerate(texts)] + [(50, None, "y", 0, 1), (None, "one two", "z", 0, 1), (None, "one two", "z", 0, 1), (60, "b b", "k", 0, 1), (60, "a a", "k", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, place long, component_id int")
    out = op9_jaccard.stage(spark, docs, "")
    want = expected_components(texts)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.filter("doc_id is not null").collect() if r.doc_id != 50) == sorted([(i, texts[i]) for i, (_, c) in want.items() if i == c] + [(60, "a a")])
    assert out.filter("doc_id is null").count() == 2 and out.filter("doc_id = 50").count() == 1
    unique = spark.createDataFrame(rows[:12], docs.schema)
    assert sorted(r.doc_id for r in op9_jaccard.stage(spark, unique, "").collect()) == [i for i, (_, c) in want.items() if i == c]


def slow_kernel(s, t, p=op10_toxicity.ORDER, lam=op10_toxicity.DECAY):
    from itertools import combinations

    f = lambda x: [(tuple(x[i] for i in c), lam ** (c[-1] - c[0] + 1)) for c in combinations(range(len(x)), p)]
    return sum(a * b for u, a in f(s) for v, b in f(t) if u == v)


def test_subsequence_kernel():
    pairs = [("idiot", "idxiot"), ("abcabc", "aabbcc"), ("ab", "abc"), ("moron", "clown")]
    x, y = (op10_toxicity._coded([p[k] for p in pairs]) for k in (0, 1))
    assert op10_toxicity.subsequence_kernel(x, y) == pytest.approx([slow_kernel(*p) for p in pairs], rel=1e-4)


def test_likeness_against_brute_force():
    marks = op10_toxicity.Landmarks(["idiot", "banana", "größe", "ab", "idiot", "disgusting"])
    words = ["idiot", "idxiot", "iidiioott", "bananas", "nabana", "groß", "größer", "ab", "", "x", "zzzzz", "disgustng", "banananananana", "数字数字", "idioti" * 3]
    got = marks.similar(words)
    for w, row in zip(words, got, strict=True):
        for m, v in zip(marks.words, row.tolist(), strict=True):
            both = slow_kernel(w[:20], w[:20]) * slow_kernel(m, m)
            k = slow_kernel(w[:20], m) / both**0.5 if both else 0.0
            assert v == pytest.approx(min(1, max(0, (k - op10_toxicity.CHANCE) / (op10_toxicity.WHOLE - op10_toxicity.CHANCE))), abs=1e-3)
    assert marks.similar([]).shape == (0, 6) and op10_toxicity.Landmarks([]).similar(["a"]).shape == (1, 0)


#: Insults of the labelled data, each with one letter inserted.
ALTERED = """traash trxash tkrash trasjh trasqh pathzetic paathetic pathetwic pathetikc pbathetic idxiot idioot ildiot idijot idiomt
disgusxting dizsgusting disgustqing disguksting dishgusting worthlkess worthxless wzorthless wortjhless worthlesus stupxid stukpid sztupid stupmid stuzpid
clowwn clojwn cplown clozwn cluown losxer lokser lpser loiser lozser scuxm sczum scuum sckum spcum morkon mojron mworon moroxn mozron""".split()
CARRIERS = ["Thtion ereded the {} onnted of erly.", "In atha heess {} the onan ndly.", "Thoner of this {} anded in whre."]


def test_toxicity_tolerates_inserted_letters(spark):
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = op10_toxicity.train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"), labels)
    caught = model.scores(pa.array([c.format(w) for w in ALTERED for c in CARRIERS])) >= 0.5
    assert caught.mean() >= 0.9
    assert not (model.scores(pa.array([c.format(w) for w in ("the", "ontion", "theatsh", "clean", "watered") for c in CARRIERS])) >= 0.5).any()


def test_toxicity_held_out_and_ties(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs.filter("doc_id < 50"))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = op10_toxicity.scored(twice, labels, held).collect()
    assert len(rows) == twice.count()
    seen = {}
    for r in rows:
        assert seen.setdefault(r.doc_id, (r.score, r.predicted)) == (r.score, r.predicted) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    mine = [(seen[i][1], truth[i]) for i in seen if i in truth and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in mine]) >= 0.93


def test_toxicity_stage(spark, tmp_path):
    clean = "The weather was mild and the garden looked green. We walked for hours along the river."
    rows = [(i, f"{clean} You moron. You are an idiot, you moron." if i % 3 == 0 else f"{clean} Goodbye {i}.", 0.5, 1) for i in range(90)] + [(None, clean, 0.1, 0), (200, None, 0.2, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = op10_toxicity.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted([i for i in range(90) if i % 3] + [None, 200], key=str)
    assert op10_toxicity.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_toxicity(spark):
    import pyarrow as pa

    clean = "The weather was mild and the garden looked green. We walked for hours along the river."
    rows = [(i, f"{clean} You are an {'idiot' if i % 2 else 'absolute moron'}. Goodbye {i}." if i % 3 == 0 else f"{clean} Goodbye {i}.", i) for i in range(120)] + [(500, None, 0), (501, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in op10_toxicity.scored(docs, labels, F.col("doc_id") % 5 == 0).collect()}
    assert len(got) == 122 and sum(got[i].predicted == (i % 3 == 0) for i in range(120)) >= 116 and got[500].predicted == 0
    model = op10_toxicity.train(docs, labels)
    p = model.scores(pa.array([clean, clean + " You are an idxiot.", clean + " You are an i d i o t", None]))
    assert p[1] >= 0.5 > p[0] and p[2] >= 0.5 > p[3]
    assert {r.predicted for r in op10_toxicity.scored(docs, labels.limit(0), F.lit(False)).collect()} == {0}
    assert op10_toxicity.scored(docs.limit(0), labels, F.lit(False)).count() == 0


def test_toxicity_of_long_texts(monkeypatch):
    """A text read in pieces scores as one read at once."""
    import pyarrow as pa

    model = op10_toxicity.Model(op10_toxicity.Landmarks(["idiot", "moron"]), np.array([1.0, 1.0]), -0.5, np.array([0.0, 1.0, 1.0]))
    clean = "The weather was mild and the garden looked green. "
    texts = [clean * 40 + "You idiot.", clean * 3 + "You idiot and moron you idiot and moron " * 8 + ". " + clean, "We saw i d i o t " * 20 + "\n" + clean * 5, (clean + "You moron. ") * 30, "x" * 500 + " idiot", " \n" * 300]
    whole = [model.features(pa.array([t]))[0].tolist() for t in texts]
    assert whole[0][1] == pytest.approx(1 / 41)
    for size in (16, 50, 64, 97):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        monkeypatch.setattr(op10_toxicity, "CHUNK_BYTES", size)
        assert [model.features(pa.array([t]))[0].tolist() for t in texts] == whole


def test_toxicity_learns_from_whole_sentences(spark):
    """The insult comes late in a text without an end mark."""
    plain = [f"{w} garden river weather walk" for w in ("mild", "green", "long", "warm")]
    rows = [(i, " ".join([plain[(i + k) % 4] for k in range(60)] + (["you absolute moron"] if i % 2 else ["see you soon"]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = op10_toxicity.train(docs, labels)
    assert model.alpha @ model.landmarks.similar(["moron"])[0] > 0.1 > abs(model.alpha @ model.landmarks.similar(["weather"])[0])


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage decides on all that its predecessor kept; the end is the brute-force result of the stages' decisions."""
    import corpus_pipeline

    for t in ("documents", "labels"):
        frame = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "documents":
            more = spark.createDataFrame([(9001, "You idiot. You moron. " * 5, "en", "s", 110), (9002, None, None, None, None), (9003, "", "en", "s", 0)], frame.schema)
            frame = frame.unionByName(more)
        frame.write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "toxicity":
            scored = op10_toxicity.scored(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")).collect()
            want = sorted(r.doc_id for r in scored if not r.predicted)
        elif name == "quality classifier":
            want = sorted(r.doc_id for r in op2_quality.resampled(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect())
        elif name == "n-gram Jaccard join":
            ids = sorted(kept)
            found = expected_components([kept[i] for i in ids])
            want = [ids[k] for k, (_, c) in found.items() if k == c]
        elif name == "mixing sources to target weights":
            want = sorted(r.doc_id for r in op1_mixing.mixed(docs).collect() for _ in range(r.copies if words(kept[r.doc_id]) else 0))
        else:
            used = defaultdict(list)
            for r in rows:
                used[r.sequence_id].append((r.offset, r.length))
            assert sum(r.piece == 0 for r in rows) == docs.count()
            for pieces in used.values():
                assert sum(n for _, n in pieces) <= 2048 and len(pieces) <= op5_packing.STAGE_DOCUMENTS
            continue
        assert out.columns == columns and sorted(r.doc_id for r in rows) == want and all(r.text == kept[r.doc_id] for r in rows)
        kept = {i: kept[i] for i in want}
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)
