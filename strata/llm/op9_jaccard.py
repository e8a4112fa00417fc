"""Exact n-gram Jaccard join with signature trees.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their distinct
5-word shingles.  Of documents with one shingle set, one stands for all.
Documents that link share one of the first quarter of their shingles in any
fixed order, so candidates meet in the groups of such prefix shingles;
shingles known to be frequent come last in the order.  The members of a group
form a signature tree: a leaf is a document with a bitmap of its shingles, a
node holds the OR (and the AND) of its members' bitmaps and the range of their
sizes.  A dual traversal drops node pairs whose largest possible overlap is too
small, and those that lie in one component already.

Larger groups are settled first: every document goes to one of its groups, in
blocks of bounded size, where the tree's bitmaps have a bit for each shingle
that two members share, so its leaves give exact overlaps and only links leave
the task.  What other groups leave open is verified on the whole shingle sets.

A group too large for one task is cut into blocks by component and size.  The
blocks' nodes alone are traversed first; members then travel only to the pairs
of blocks that these nodes leave open.

Up to LOCAL_ROWS links, pairs or ids are merged, dealt in turns or made
distinct by the driver, as a shuffle costs a task for every partition, however
few its rows; more of them go through joins and aggregates with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, local_frame, mapped, materialize, shared, shingle_sets, small_side, table, unused

SIG_MIN, SIG_MAX = 256, 65536
FANOUT = 8
#: Shingles that come up twice in a window of so many are counted as possibly frequent; those with hashes in the upper
#: half, which come late in the order as it is, are not counted.
WINDOW = 1 << 21
#: Shingles counted so often come last in the order (which shingles these are affects speed alone).
FREQUENT = 8
#: Filters of ids and of frequent shingles have 16 to 32 bits for each, within these bounds; beyond, they let more pass.
LEAST_BITS, MOST_BITS = 16, 28
TASK_ROWS = 400_000
#: Rows of a group that a task holds to tell groups of the same documents; larger ones pass through.
HELD_ROWS = 500_000
#: A group of up to so many rows is a single node, whose leaves are paired at once.
SMALL = 16
SLICE = 500
PAIRS = "a long, b long, cut boolean"
#: Documents in a block of a group, and times that documents are dealt to their groups.
BLOCK = 512
ROUNDS = 2
#: Rows beyond which the traversal of a group is cut into blocks.
SPLIT = 1024
#: Ids to drop that the stage sends to every task at most (16 MB); beyond, documents are joined with them.
DROP_ROWS = 1_000_000
#: Links, pairs or ids (4 MB as pairs) that the driver takes at most; beyond, they stay in tables.
LOCAL_ROWS = 1 << 18
#: Bytes of exact bitmaps that a block may use; beyond, hashed ones and whole sets.
EXACT_BYTES = 1 << 26
#: Partners of a document that the first pass over a larger group looks at.
PARTNERS = 64
ODD = np.uint64(0x9E3779B97F4A7C15)


def enough(common, a, b):
    return 7 * common >= 3 * (a + b)


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set, of twice its size rounded up to a power of two, within bounds."""
    bits = SIG_MIN
    while bits < 2 * len(s) and bits < SIG_MAX:
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller size."""
    return np.bitwise_or.reduce(sig.reshape(-1, words), axis=0)


def overlap_bound(or_a, and_a, max_a, or_b, and_b, max_b):
    """Largest overlap that a member of A and one of B can have: bits that all of A set and none of B does are lost."""
    lost_a = np.bitwise_count(and_a & ~or_b).sum(-1, dtype=np.int64)
    lost_b = np.bitwise_count(and_b & ~or_a).sum(-1, dtype=np.int64)
    return np.minimum(max_a - lost_a, max_b - lost_b)


class SignatureTree:
    """Levels of nodes, from leaves up, over documents ordered by size and bitmap."""

    def __init__(self, any_: np.ndarray, all_: np.ndarray, low: np.ndarray, high: np.ndarray, c0: np.ndarray, c1: np.ndarray):
        """Leaves with the OR and AND of their bitmaps and the ranges of their sizes and components."""
        self.order = np.lexsort((any_[:, 0], c0, low))
        self.levels = [tuple(x[self.order] for x in (any_, all_, low, high, c0, c1))]
        while len(self.levels[-1][2]) > 1:
            o, a, low, high, c0, c1 = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(o, at), np.bitwise_and.reduceat(a, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    @classmethod
    def of(cls, sizes: np.ndarray, sigs: np.ndarray, comps: np.ndarray) -> SignatureTree:
        """A tree whose leaves are documents."""
        return cls(sigs, sigs, sizes, sizes, comps, comps)

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        o, a, low, high, c0, c1 = self.levels[level]
        ok = (c0[i] != c1[i]) | (c0[j] != c1[j]) | (c0[i] != c0[j])
        ok &= (4 * high[i] >= 3 * low[j]) & (4 * high[j] >= 3 * low[i])
        at = np.flatnonzero(ok)
        for lo in range(0, len(at), 1 << 14):
            k = at[lo : lo + (1 << 14)]
            x, y = i[k], j[k]
            ok[k] = enough(overlap_bound(o[x], a[x], high[x], o[y], a[y], high[y]), low[x], low[y])
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf pairs (by place in the input) that may link and lie in different components."""
        stack = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                apart = i < j
                i, j = i[apart], j[apart]
            if not len(i):
                continue
            ok = self._possible(level, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j]
                continue
            below = len(self.levels[level - 1][2])
            for lo in range(0, len(i), 2048):  # bounded frontier
                k = np.arange(FANOUT)
                x = (i[lo : lo + 2048, None, None] * FANOUT + k[:, None] + 0 * k).reshape(-1)
                y = (j[lo : lo + 2048, None, None] * FANOUT + 0 * k[:, None] + k).reshape(-1)
                keep = (x < below) & (y < below) & (x <= y)
                stack.append((level - 1, x[keep], y[keep]))


def _by_class(sizes, sigs: list[np.ndarray], comps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a group: bitmaps of one length, with those of twice the length folded.

    Sizes of linking sets differ by a third at most, so their bitmaps' lengths by one doubling.
    """
    words = np.array([len(s) for s in sigs])
    for w in np.unique(words).tolist():
        here = np.flatnonzero((words == w) | (words == 2 * w))
        if len(here) < 2:
            continue
        stack = np.stack([sigs[k] if words[k] == w else fold(sigs[k], w) for k in here.tolist()])
        for i, j in SignatureTree.of(sizes[here], stack, comps[here]).pairs():
            a, b = here[i], here[j]
            mine = (words[a] == w) | (words[b] == w)
            yield a[mine], b[mine]


def _slices(batches, *cols):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield shingle_sets(part.column("text")), *(part.column(c).to_pylist() for c in cols)


SURVEY = ["doc", "n", "sig", "h1", "h2", "token"]


def _set_hashes(s: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(s).view(np.int64)), int(np.bitwise_xor.reduce((s ^ (s >> np.uint64(29))) * ODD).view(np.int64))


def _survey(batches):
    """Size, bitmap and set hashes of every document; counts of shingles that repeat within a window."""
    window: list[np.ndarray] = []
    held, seen = 0, []

    def close():
        token = np.concatenate(window)
        window.clear()
        token.sort()
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(first, len(token)))
        seen.append((token[first[n >= 2]], n[n >= 2]))

    for sets, ids in _slices(batches, "doc_id"):
        docs, sizes, sigs, h1, h2 = [], [], [], [], []
        for doc, s in zip(ids, sets, strict=True):
            docs.append(doc)
            sizes.append(len(s))
            a, b = _set_hashes(s)
            h1.append(a)
            h2.append(b)
            sigs.append(signature(s).tobytes() if len(s) else None)
            window.append(s[: int(np.searchsorted(s, np.uint64(1 << 63)))])
            held += len(window[-1])
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.nulls(len(docs), pa.int64())], SURVEY)
        if held >= WINDOW:
            close()
            held = 0
    if held:
        close()
    for token, n in seen:
        yield pa.RecordBatch.from_arrays([pa.nulls(len(token), pa.int64()), pa.array(n.astype(np.int64)), pa.nulls(len(token), pa.binary()), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int64()), pa.array(token.view(np.int64))], SURVEY)


def _in_filter(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    at = (place & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7)) & 1 == 1


def _places(keys: np.ndarray) -> np.ndarray:
    """Where keys stand in a filter; as _mark."""
    k = keys.astype(np.int64).view(np.uint64)
    return k ^ (k >> np.uint64(20)) ^ (k >> np.uint64(40))


def _is_marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return _in_filter(marks, _places(keys))


def _mark(key):
    """Where a key stands in a filter, before the filter's size is taken into account; as _places."""
    return F.col(key).bitwiseXOR(F.shiftrightunsigned(key, 20)).bitwiseXOR(F.shiftrightunsigned(key, 40))


def _prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set that a linking set must share one of: rare ones by hash, then frequent ones."""
    k = len(s) - (3 * len(s) + 3) // 4 + 1
    late = _in_filter(frequent, s >> np.uint64(20))
    early = s[~late]
    return early[:k] if len(early) >= k else np.concatenate([early, s[late][: k - len(early)]])


def _units(batches, marks: np.ndarray, by_set: bool):
    """Keys and shingle sets, a slice at a time, of the rows whose key the filter lets pass.

    The key is the doc_id, or, where doc_ids repeat, stands for the shingle set.
    """
    for b in batches:
        if not by_set:
            b = b.filter(pa.array(_is_marked(marks, b.column("doc_id").to_numpy())))
        for found, ids in _slices([b], "doc_id"):
            keys, sets = [], []
            for doc, s in zip(ids, found, strict=True):
                if len(s):
                    h1, h2 = _set_hashes(s) if by_set else (0, 0)
                    keys.append(h1 ^ h2 ^ len(s) if by_set else doc)
                    sets.append(s)
            if by_set and keys:
                on = _is_marked(marks, np.array(keys, np.int64)).tolist()
                keys, sets = [k for k, o in zip(keys, on, strict=True) if o], [s for s, o in zip(sets, on, strict=True) if o]
            if keys:
                yield keys, sets


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges between u and v, in order, and the smallest id reachable from each."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return names, names[np.array([_find(parent, k) for k in range(len(names))], np.int64)]


def _emitter(frequent: np.ndarray, marks: np.ndarray, by_set: bool):
    """Prefix rows of the marked documents."""

    def run(batches):
        for keys, sets in _units(batches, marks, by_set):
            prefixes = [_prefix(s, frequent) for s in sets]
            lens = [len(p) for p in prefixes]
            token = np.concatenate(prefixes).view(np.int64)
            key, n = np.repeat(np.array(keys, np.int64), lens), np.repeat(np.array([len(s) for s in sets], np.int64), lens)
            for lo in range(0, len(token), 50_000):
                hi = lo + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(token[lo:hi]), pa.array(key[lo:hi]), pa.array(n[lo:hi])], ["token", "doc", "n"])

    return run


GROUPS = ["token", "doc", "n", "rows", "same"]


def _grouped(batches):
    """Of prefix rows in order of token and doc, each once, those whose shingle has two documents or more.

    ``same`` is equal for groups of the same documents.  A group of over
    HELD_ROWS rows passes through, with that number and a ``same`` of its own.
    """
    held = [np.zeros(0, np.int64) for _ in range(3)]  # the group that the next batch may go on with
    large = None  # the token of a group that passes through

    def given(token, doc, n, whole):
        nonlocal large
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc, n = token[fresh], doc[fresh], n[fresh]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        d = doc.view(np.uint64)
        with np.errstate(over="ignore"):
            same = np.add.reduceat((d ^ (d >> np.uint64(31))) * ODD, first) ^ np.add.reduceat(((d * ODD) ^ ((d * ODD) >> np.uint64(27))) * ODD, first)
        same, rows = same.view(np.int64).copy(), size.copy()
        if not whole or (large is not None and token[0] == large):
            k = -1 if not whole else 0
            same[k], rows[k] = token[first[k]], HELD_ROWS + 1
        keep = np.repeat(rows > 1, size)
        cols = [token[keep], doc[keep], n[keep], np.repeat(rows, size)[keep], np.repeat(same, size)[keep]]
        for lo in range(0, len(cols[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 20_000]) for c in cols], GROUPS)

    for b in batches:
        if not b.num_rows:
            continue
        token, doc, n = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("token", "doc", "n"), strict=True))
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield from given(token[:last], doc[:last], n[:last], True)
            large = None if token[-1] != large else large
        if len(token) - last > HELD_ROWS or token[-1] == large:
            large = int(token[-1])
            end = last + int(np.searchsorted(doc[last:], doc[-1]))  # rows of the last document may go on
            if end > last:
                yield from given(token[last:end], doc[last:end], n[last:end], False)
            held = [token[end:], doc[end:], n[end:]]
        else:
            held = [token[last:], doc[last:], n[last:]]
    if len(held[0]):
        yield from given(*held, True)


def _once_each(batches):
    """Of rows in order of same and token, those of the first token of each ``same``."""
    same_now, token_now = None, None
    for b in batches:
        if not b.num_rows:
            continue
        same, token = b.column("same").to_numpy(), b.column("token").to_numpy()
        turn = np.concatenate([[same[0] != same_now], same[1:] != same[:-1]])
        at = np.maximum.accumulate(np.where(turn, np.arange(len(same)), -1))
        chosen = np.where(at >= 0, token[np.maximum(at, 0)], token_now if token_now is not None else 0)
        yield b.filter(pa.array(token == chosen)).select(GROUPS[:4])
        same_now, token_now = same[-1], int(chosen[-1])


def _exact_bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """Bitmaps with a bit for every shingle of two sets or more; None where they would be too large."""
    token = np.concatenate(sets)
    _, code, n = np.unique(token, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    words = max(1, -(-int(np.count_nonzero(n > 1)) // 64))
    if words * 8 * len(sets) > EXACT_BYTES:
        return None
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = n[code] > 1
    owner, at = owner[often], place[code[often]]
    out = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(out, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def _links_of(n, comp, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Components that links between members join: each with the smallest one that it is joined with."""
    names, root = np.unique(comp, return_inverse=True)
    parent = list(range(len(names)))
    bits = _exact_bits(sets)
    pairs = _by_class(n, [signature(s) for s in sets], comp) if bits is None else SignatureTree.of(n, bits, comp).pairs()
    for i, j in pairs:
        for lo in range(0, len(i), 1 << 12):
            x, y = i[lo : lo + (1 << 12)], j[lo : lo + (1 << 12)]
            if bits is not None:
                ok = enough(np.bitwise_count(bits[x] & bits[y]).sum(-1, dtype=np.int64), n[x], n[y])
                x, y = x[ok], y[ok]
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                rp, rq = _find(parent, int(root[p])), _find(parent, int(root[q]))
                if rp != rq and (bits is not None or enough(shared(sets[p], sets[q]), n[p], n[q])):
                    parent[max(rp, rq)] = min(rp, rq)
    ends = [_find(parent, k) for k in range(len(names))]
    return [(int(names[k]), int(names[end])) for k, end in enumerate(ends) if k != end]


def _blocks(batches, *cols, by="block", least=2):
    """Columns of each block of ``least`` rows or more; rows come in order of blocks."""
    now, rows = None, []
    for b in batches:
        for block, *row in zip(*(b.column(c).to_pylist() for c in (by, *cols)), strict=True):
            if block != now:
                if len(rows) >= least:
                    yield now, list(zip(*rows, strict=True))
                now, rows = block, []
            rows.append(row)
    if len(rows) >= least:
        yield now, list(zip(*rows, strict=True))


def _in_question(batches):
    """Members of a block for which bitmaps leave a partner of another component open."""
    for block, (doc, n, comp, sig) in _blocks(batches, "doc", "n", "comp", "sig"):
        doc, n, comp = np.array(doc), np.array(n), np.array(comp)
        some = np.zeros(len(doc), bool)
        for i, j in _by_class(n, [np.frombuffer(x, np.uint64) for x in sig], comp):
            some[i] = some[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(n[some]), pa.array(comp[some]), pa.array(np.full(int(some.sum()), block))], ["doc", "n", "comp", "block"])


def _settle(batches):
    """Components that links within each block of a group join."""
    for _, (n, comp, raw) in _blocks(batches, "n", "comp", "shingles"):
        found = _links_of(np.array(n), np.array(comp), [_unpacked(r) for r in raw])
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


BLOCKS = [f"block{k}" for k in range(ROUNDS)]
#: A document names its smallest large group in each of so many classes.
LOWS = [f"low{k}" for k in range(4)]
NO_TOKEN = -(1 << 63)


def _settled(blocks, i, j):
    """Pairs that were in one block."""
    return np.any([(b[i] == b[j]) & (b[i] != 0) for b in blocks], axis=0)


def _leaf_pairs(batches):
    """Pairs of small groups, each one node of leaves: those of fitting sizes from different components, once each."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    order = np.argsort(t.column("token").to_numpy(), kind="stable")
    token, doc, n, comp, *blocks = (t.column(c).to_numpy()[order] for c in ("token", "doc", "n", "comp", *BLOCKS))
    names, code = np.unique(doc, return_inverse=True)
    keys = np.zeros(0, np.int64)
    for d in range(1, SMALL):
        if d >= len(token):
            break
        i = np.flatnonzero((token[d:] == token[:-d]) & (comp[d:] != comp[:-d]))
        if not len(i):
            continue
        j = i + d
        fit = (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & ~_settled(blocks, i, j)
        x, y = code[i[fit]], code[j[fit]]
        keys = np.union1d(keys, np.minimum(x, y) * len(names) + np.maximum(x, y))
    for lo in range(0, len(keys), 50_000):
        k = keys[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[k // len(names)]), pa.array(names[k % len(names)]), pa.array(np.zeros(len(k), bool))], ["a", "b", "cut"])


MEMBERS = ["work", "token", "side", "doc", "n", "sig", "comp", *BLOCKS, *LOWS]


def _tree_pairs(limit: int):
    """Pairs of larger groups by dual traversal, at most ``limit`` partners a document and piece of work.

    A piece of work is a group, a block of a large one, or two such blocks (the sides 1 and 2), between which alone
    pairs are then sought.  A row with cut set names the shingle of a group with pairs put off; the next round looks at
    such groups with a larger limit.
    """

    def traverse(token, rows, out):
        side, doc, n, comp = (np.array([r[k] for r in rows]) for k in (0, 1, 2, 4))
        blocks = np.array([r[5 : 5 + ROUNDS] for r in rows]).T
        lows = np.array([r[5 + ROUNDS :] for r in rows])
        have, cut = np.zeros(len(rows), np.int64), False
        for i, j in _by_class(n, [np.frombuffer(r[3], np.uint64) for r in rows], comp):
            # of the groups that two documents share, the one that both name deals with them
            both = (lows[i] == lows[j]) & (lows[i] != NO_TOKEN)
            first = np.where(both, lows[i], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            open_ = ~_settled(blocks, i, j) & (~both.any(axis=1) | (first == token)) & ((side[i] == 0) | (side[i] != side[j]))
            i, j = i[open_], j[open_]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if have[x] >= limit and have[y] >= limit:
                    cut = True
                    continue
                have[x] += 1
                have[y] += 1
                out.add((int(min(doc[x], doc[y])), int(max(doc[x], doc[y]))))
        return cut

    def batch_of(pairs, cut):
        a, b = [p[0] for p in pairs] + cut, [p[1] for p in pairs] + cut
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([False] * len(pairs) + [True] * len(cut), pa.bool_())], ["a", "b", "cut"])

    def run(batches):
        out, cut = set(), []
        for _, (tokens, *cols) in _blocks(batches, *MEMBERS[1:], by="work"):
            if traverse(tokens[0], list(zip(*cols, strict=True)), out):
                cut.append(tokens[0])
            if len(out) > 200_000:
                yield batch_of(out, cut)
                out, cut = set(), []
        yield batch_of(out, cut)

    return run


NODES = "token long, block long, any_ binary, all_ binary, low long, high long, c0 long, c1 long"


def _block_nodes(batches):
    """The node of each block of a large group: OR and AND of the bitmaps, ranges of sizes and components."""
    for block, (token, n, sig, comp) in _blocks(batches, "token", "n", "sig", "comp", by="work", least=1):
        sigs = [np.frombuffer(x, np.uint64) for x in sig]
        words = min(map(len, sigs))
        stack = np.stack([fold(x, words) for x in sigs])
        row = [token[0], block, np.bitwise_or.reduce(stack).tobytes(), np.bitwise_and.reduce(stack).tobytes(), min(n), max(n), min(comp), max(comp)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], ["token", "block", "any_", "all_", "low", "high", "c0", "c1"])


def _block_pairs(batches):
    """Pairs of blocks of a group that their nodes do not rule out."""
    for token, (block, any_, all_, *ranges) in _blocks(batches, "block", "any_", "all_", "low", "high", "c0", "c1", by="token"):
        any_, all_ = ([np.frombuffer(x, np.uint64) for x in xs] for xs in (any_, all_))
        block, ranges, words = np.array(block), [np.array(r) for r in ranges], np.array([len(x) for x in any_])
        for w in np.unique(words).tolist():
            here = np.flatnonzero(words >= w)
            tree = SignatureTree(*(np.stack([fold(x[k], w) for k in here.tolist()]) for x in (any_, all_)), *(r[here] for r in ranges))
            for i, j in tree.pairs():
                x, y = here[i], here[j]
                mine = (words[x] == w) | (words[y] == w)
                x, y = block[x[mine]], block[y[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), token)), pa.array(x), pa.array(y)], ["token", "x", "y"])


def _packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, which tell the shingles of two documents apart."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _whole_sets(marks: np.ndarray, by_set: bool):
    """Shingle sets of the marked documents."""

    def run(batches):
        for keys, sets in _units(batches, marks, by_set):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([_packed(s) for s in sets], pa.binary())], ["doc", "shingles"])

    return run


def _marked_rows(marks: np.ndarray):
    """Rows of the marked keys, so that the others cross no shuffle."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_is_marked(marks, b.column("doc").to_numpy())))

    return run


def _verify(batches):
    for b in batches:
        ok = [bool(enough(shared(_unpacked(x), _unpacked(y)), len(x) // 6, len(y) // 6)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def components(edges: DataFrame, save=materialize) -> DataFrame:
    """(doc, comp): the smallest id reachable from every id in edges (a, b), by alternating stars.

    Kiveris et al. 2014, "Connected Components in MapReduce and Beyond".  All
    steps are joins and aggregates; nothing but a count comes to the driver.
    """
    both = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    while True:
        # done when every id has one smaller neighbour, or only larger ones
        ends = both.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(both.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
        near = both.union(both.select("v", "u")).toDF("u", "v")
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        both = save(small)
    return save(nodes.join(both.select(F.col("u").alias("doc"), F.col("v").alias("comp")), "doc", "left").select("doc", F.coalesce("comp", "doc").alias("comp")))


def _filter_bits(most: int) -> int:
    return 1 << min(MOST_BITS, max(LEAST_BITS, int(16 * most).bit_length()))


def _filter_of(places: np.ndarray) -> np.ndarray:
    """A filter of places that the driver has."""
    bits = _filter_bits(len(places))
    out = np.zeros(bits // 8, np.uint8)
    at = (places & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def _filter(places: DataFrame, column: str, most: int) -> np.ndarray:
    """A filter of the places in a column, sized for ``most`` of them; the driver gets 2**MOST_BITS / 8 bytes at most."""
    if most <= LOCAL_ROWS:
        return _filter_of(places.toArrow().column(column).to_numpy().view(np.uint64))
    bits = _filter_bits(most)
    out = np.zeros(bits // 8, np.uint8)
    size = 1 << 12
    # bitmap functions count from 1, 32768 to a bucket
    rows = places.select((F.col(column).bitwiseAND(F.lit(bits - 1)) + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    for r in rows:
        at = (r["k"] - 1) * size
        out[at : at + size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _taken(rows: DataFrame) -> list[np.ndarray] | None:
    """The columns of a written table, if the driver may take its rows."""
    if rows.count() > LOCAL_ROWS:
        return None
    return [c.to_numpy() for c in rows.toArrow().columns]


def _sent(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """Columns of the driver as a table that every task gets."""
    return F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links, the document's
    own included.  Texts without words, and null ones, have no shingle and link
    with nothing.  Rows that share a doc_id count as one document: what any of
    its texts links with is in its component, which all its rows show, each
    with the size of its own text.  Rows with a null doc_id get their size and
    a null component, and link with nothing.  Extra columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.filter("doc_id is not null")
    written: list[str] = []

    def save(df):
        return materialize(df, written)

    survey = materialize(mapped(rows, _survey, "doc long, n long, sig binary, h1 long, h2 long, token long"))
    sizes = survey.filter("token is null").select("doc", "n", "sig", "h1", "h2")
    often = survey.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    often = save(often.select(F.shiftrightunsigned("token", 20).alias("p")))
    frequent = _filter(often, "p", often.count())
    some = sizes.filter("n > 0 and doc is not null")
    # where doc_ids repeat, a key stands for a shingle set, else it is the doc_id
    by_set = not some.groupBy("doc").count().filter("count > 1").isEmpty()
    key = F.col("h1").bitwiseXOR(F.col("h2")).bitwiseXOR(F.col("n")) if by_set else F.col("doc")
    keyed = some.select(key.alias("doc"), "n", "sig", "h1", "h2")
    # one document stands for all with its set
    first = save(keyed.groupBy("n", "h1", "h2").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")))
    several = first.filter("doc < last").select("n", "h1", "h2", F.col("doc").alias("comp"))
    labels = save(keyed.join(several, ["n", "h1", "h2"]).select("doc", "comp").distinct())
    facts = first.agg(F.count("*"), F.sum("n")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(facts[1] or 0) // 4 // TASK_ROWS + 1)

    def marks(ids, most):
        """A filter of keys; one that it lets pass for another costs time alone."""
        return _filter(ids.select(_mark("doc").alias("p")), "p", most)

    def each_once(ids):
        """Keys of a written table, each once, and a filter of them."""
        few = _taken(ids.select("doc"))
        if few is not None:
            few = np.unique(few[0])
            return _sent(spark, doc=few), _filter_of(_places(few))
        ids = save(ids.select("doc").distinct())
        return ids, marks(ids, ids.count())

    def sets_of(ids):
        found = mapped(known, _whole_sets(each_once(ids)[1], by_set), "doc long, shingles binary")
        return save(found.dropDuplicates(["doc"]) if by_set else found)

    def sigs_of(ids):
        """doc, n, sig of keys, each once."""
        ids, marked = each_once(ids)
        found = keyed.select("doc", "n", "sig").mapInArrow(_marked_rows(marked), "doc long, n long, sig binary").join(ids, "doc", "left_semi")
        return found.groupBy("doc").agg(F.first("n").alias("n"), F.first("sig").alias("sig")) if by_set else found

    sent = mapped(known, _emitter(frequent, marks(first, facts[0]), by_set), "token long, doc long, n long")
    groups = sent.repartition(tasks, "token").sortWithinPartitions("token", "doc").mapInArrow(_grouped, "token long, doc long, n long, rows long, same long")
    groups = groups.repartition(tasks, "same").sortWithinPartitions("same", "token").mapInArrow(_once_each, "token long, doc long, n long, rows long")
    groups = save(groups)
    few, large = groups.filter(F.col("rows") <= SMALL), groups.filter(F.col("rows") > SMALL)
    large_sigs = None

    def with_state(members, blocks=None):
        """Members with their component and, if wanted, their blocks."""
        out = members.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        return out if blocks is None else out.join(blocks, "doc", "left").fillna(0, BLOCKS)

    def opened(members):
        """Members, with component, of groups with several."""
        here = with_state(members.select("token", "doc", "n"))
        open_ = here.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("rows")).filter("c0 <> c1")
        open_ = save(open_.select("token", "rows"))
        return save(here.join(small_side(open_, open_.count()), "token"))

    def settle(members, blocks, name):
        """Deal each document of larger groups to one of them and find the links there; adds the blocks' ids to ``blocks``."""
        nonlocal labels
        # the largest, then one by hash, which like documents often share
        choice = F.struct(F.lit(0) if name != BLOCKS[0] else F.col("rows"), F.xxhash64("token", F.lit(name)).alias("h"), "token")
        dealt = members.groupBy("doc").agg(F.max(choice).alias("g"), F.first("n").alias("n"), F.first("comp").alias("comp"))
        dealt = save(dealt.select("doc", "n", "comp", F.col("g.token").alias("token")))
        count = dealt.groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
        part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("c") / BLOCK))
        here = save(dealt.join(count.select("token", "c"), "token").select("doc", "n", "comp", F.xxhash64("token", part).alias("block")))
        if here.isEmpty():
            return blocks.withColumn(name, F.lit(0).cast("long"))
        asked = here.join(large_sigs.select("doc", "sig"), "doc").repartition(tasks, "block").sortWithinPartitions("block", "doc")
        asked = save(asked.select("block", "doc", "n", "comp", "sig").mapInArrow(_in_question, "doc long, n long, comp long, block long"))
        found = asked.join(sets_of(asked), "doc").repartition(tasks, "block").sortWithinPartitions("block", "doc")
        found = save(found.select("block", "n", "comp", "shingles").mapInArrow(_settle, "a long, b long"))
        labels = merged(found)
        both = blocks.join(here.select("doc", F.col("block").alias(name)), "doc", "full")
        return save(both.select("doc", *[F.coalesce(c, F.lit(0)).alias(c) for c in both.columns[1:]]))

    def merged(links):
        """Labels after more links: only components that these join are looked at."""
        few = _taken(links.select("a", "b"))
        if few is not None:
            return relabelled(*few)
        one, two = (labels.select(F.col("doc").alias(k), F.col("comp").alias(f"c{k}")) for k in "ab")
        ends = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        new = components(ends, save)
        now = labels.join(new.select(F.col("doc").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("doc", F.coalesce("new", "comp").alias("comp"))
        return save(now.union(new.join(labels.select("doc"), "doc", "left_anti").select("doc", "comp")))

    def labels_of(ids):
        """Components of keys that the driver has, and which of them have a label."""
        comp, labelled = ids.copy(), np.zeros(len(ids), bool)
        found = labels.join(_sent(spark, doc=ids), "doc").select("doc", "comp").toArrow()
        at = np.searchsorted(ids, found.column("doc").to_numpy())
        comp[at], labelled[at] = found.column("comp").to_numpy(), True
        return comp, labelled

    def relabelled(a, b):
        """Labels after more links, which the driver has."""
        if not len(a):
            return labels
        ids = np.unique(np.concatenate([a, b]))
        comp, labelled = labels_of(ids)
        names, roots = _united(*(comp[np.searchsorted(ids, x)] for x in (a, b)))
        new = _sent(spark, comp=names, new=roots)
        now = labels.join(new, "comp", "left").select("doc", F.coalesce("new", "comp").alias("comp"))
        # a component's smallest document always has a label, so these are documents of the links
        fresh = ids[~labelled]
        return save(now.union(_sent(spark, doc=fresh, comp=roots[np.searchsorted(names, fresh)])))

    def in_blocks(hot, members):
        """Work of the members of groups of over SPLIT rows: their blocks, and the pairs of blocks that the blocks' nodes leave open."""
        # components of a block or more have blocks of their own
        own = save(hot.groupBy("token", "comp").agg(F.count("*").alias("of_comp")).filter(F.col("of_comp") >= BLOCK).select("token", "comp", F.col("comp").alias("own")))
        own = small_side(own, own.count())

        def celled(rows):
            cell = rows.join(own, ["token", "comp"], "left").fillna(NO_TOKEN, ["own"])
            return cell.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))))

        parts = celled(hot).groupBy("token", "own", "size").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        parts = save(parts.filter("parts > 1"))
        cell = celled(members).join(small_side(parts, parts.count()), ["token", "own", "size"], "left").fillna(1, ["parts"])
        cell = cell.withColumn("work", F.xxhash64("token", "own", "size", F.pmod(F.xxhash64("doc"), F.col("parts"))))
        cell = save(cell.withColumn("side", F.lit(0)).select(*MEMBERS))
        nodes = cell.repartition(tasks, "work").sortWithinPartitions("work").select("work", "token", "n", "sig", "comp").mapInArrow(_block_nodes, NODES)
        pairs = save(nodes.repartition(tasks, "token").sortWithinPartitions("token", "block").mapInArrow(_block_pairs, "token long, x long, y long"))
        ends = [pairs.select(F.xxhash64("token", "x", "y").alias("pair"), F.col(c).alias("work"), F.lit(k).alias("of")) for k, c in ((1, "x"), (2, "y"))]
        sides = cell.join(ends[0].union(ends[1]), "work")
        sides = sides.withColumn("work", F.col("pair")).withColumn("side", F.col("of"))
        return cell.union(sides.select(*MEMBERS))

    def candidates(large, limit, few=None):
        """Pairs of members that bitmaps, sizes and components leave open, and the shingles of groups with pairs put off."""
        named = [F.min(F.when(F.pmod("token", F.lit(len(LOWS))) == k, F.col("token"))) for k in range(len(LOWS))]
        named = large.groupBy("doc").agg(*[F.coalesce(c, F.lit(NO_TOKEN)).alias(k) for k, c in zip(LOWS, named, strict=True)])
        state = large_sigs.select("doc", "sig").join(named, "doc").join(blocks, "doc", "left").fillna(0, BLOCKS)
        many = large.join(state, "doc")
        work = many.filter(F.col("rows") <= SPLIT).withColumn("work", F.col("token")).withColumn("side", F.lit(0)).select(*MEMBERS)
        hot = large.filter(F.col("rows") > SPLIT)
        if not hot.isEmpty():
            work = work.union(in_blocks(hot, many.filter(F.col("rows") > SPLIT)))
        work = work.repartition(tasks, "work").sortWithinPartitions("work", "side", "n", "doc")
        found = save(work.mapInArrow(_tree_pairs(limit), PAIRS))
        # the traversal has compared the bitmaps of its own pairs
        pairs = found.filter("not cut").select("a", "b")
        if few is not None:
            leaves = with_state(few.select("token", "doc", "n"), blocks).select("token", "doc", "n", "comp", *BLOCKS)
            leaves = save(leaves.repartition(tasks, "token").mapInArrow(_leaf_pairs, PAIRS)).select("a", "b")
            taken = _taken(leaves)
            leaves = leaves.distinct() if taken is None else _sent(spark, **dict(zip("ab", np.unique(np.array(taken), axis=1), strict=True)))
            sigs = save(sigs_of(leaves.select(F.explode(F.array("a", "b")).alias("doc"))))
            one, two = (sigs.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
            pairs = pairs.union(leaves.join(one, "a").join(two, "b").mapInArrow(_bounded, "a long, b long"))
        return save(pairs.distinct().join(failed, ["a", "b"], "left_anti")), found.filter("cut").select(F.col("a").alias("token"))

    def resolve(pairs):
        """Verify pairs until each lies in one component or has failed."""
        nonlocal failed, labels
        share = 1
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc")))
        few = _taken(pairs.select("a", "b"))
        if few is not None:
            return resolve_few(sets, *few)
        while True:
            one, two = (labels.select(F.col("doc").alias(k), F.col("comp").alias(f"c{k}")) for k in "ab")
            apart = pairs.join(failed, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
            # a document with one partner after the other, then with ever more at once
            turn = save(apart.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("a"))).filter(F.col("k") <= share).select("a", "b"))
            if turn.isEmpty():
                return
            x, y = (sets.toDF(k, v) for k, v in (("a", "x"), ("b", "y")))
            checked = save(turn.join(y, "b").join(x, "a").mapInArrow(_verify, "a long, b long, ok boolean"))
            failed = save(failed.union(checked.filter("not ok").select("a", "b")))
            labels = merged(checked.filter("ok").select("a", "b"))
            share *= 16

    def resolve_few(sets, a, b):
        """Verify pairs that the driver has: the same turns, with components kept there until the end."""
        nonlocal failed, labels
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        ids = np.unique(np.concatenate([a, b]))
        names, root = np.unique(labels_of(ids)[0], return_inverse=True)
        parent = list(range(len(names)))
        x, y = (root[np.searchsorted(ids, k)] for k in (a, b))
        open_, bad, linked_, share = np.ones(len(a), bool), np.zeros(len(a), bool), np.zeros(len(a), bool), 1
        while True:
            top = np.array([_find(parent, k) for k in range(len(names))], np.int64)
            open_ &= top[x] != top[y]
            k = np.flatnonzero(open_)
            if not len(k):
                break
            # places among the open pairs of one document
            place = np.arange(len(k))
            place -= np.maximum.accumulate(np.where(np.concatenate([[True], b[k][1:] != b[k][:-1]]), place, 0))
            turn = k[place < share]
            open_[turn] = False
            sent = _sent(spark, a=a[turn], b=b[turn], at=turn)
            both = sets.withColumnRenamed("doc", "b").join(sent, "b").withColumnRenamed("shingles", "y").join(sets.toDF("a", "x"), "a")
            checked = both.select(F.col("at").alias("a"), F.col("at").alias("b"), "x", "y").mapInArrow(_verify, "a long, b long, ok boolean").toArrow()
            at, ok = checked.column("a").to_numpy(), checked.column("ok").to_numpy(zero_copy_only=False) if checked.num_rows else np.zeros(0, bool)
            bad[at[~ok]], linked_[at[ok]] = True, True
            for p, q in zip(x[at[ok]].tolist(), y[at[ok]].tolist(), strict=True):
                p, q = _find(parent, p), _find(parent, q)
                parent[max(p, q)] = min(p, q)
            share *= 16
        failed = save(failed.union(_sent(spark, a=a[bad], b=b[bad])))
        labels = relabelled(a[linked_], b[linked_])

    failed = local_frame(spark, [], "a long, b long")
    blocks, limit = local_frame(spark, [], "doc long"), PARTNERS
    if not large.isEmpty():
        large_sigs = save(sigs_of(large))
    else:
        large_sigs = local_frame(spark, [], "doc long, n long, sig binary")
    for name in BLOCKS:
        large = opened(large)
        blocks = settle(large, blocks, name)
    while True:
        large = opened(large)
        pairs, cut = candidates(large, limit, few)
        if not pairs.isEmpty():
            resolve(pairs)
        if cut.isEmpty():
            break
        # every pair of the other groups lies in one component or has failed by now
        large, few = large.join(cut, "token", "left_semi"), None
        limit *= 16
    if by_set:
        labels = _of_documents(some.select("doc", key.alias("key")), labels, save)
    labels = materialize(labels)
    discard(spark, written)
    out = sizes.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def _of_documents(rows: DataFrame, labels: DataFrame, save) -> DataFrame:
    """(doc, comp) per doc_id from rows (doc, key) and components of keys: documents join those of all their keys."""
    at = save(rows.join(labels.withColumnRenamed("doc", "key"), "key", "left").select("doc", F.coalesce("comp", "key").alias("comp")).distinct())
    low = at.groupBy("doc").agg(F.min("comp").alias("a"))
    joined = components(at.join(low, "doc").select("a", F.col("comp").alias("b")), save)
    at = save(at.join(joined.select(F.col("doc").alias("comp"), F.col("comp").alias("root")), "comp").select("doc", "root").distinct())
    return at.join(at.groupBy("root").agg(F.min("doc").alias("comp")), "root").select("doc", "comp")


def _bounded(batches):
    """Pairs whose bitmaps allow enough overlap."""
    for b in batches:
        ok = []
        for sa, na, sb, nb in zip(*(b.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")), strict=True):
            p, q = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            w = min(len(p), len(q))
            p, q = fold(p, w), fold(q, w)
            ok.append(bool(enough(int(overlap_bound(p, p, na, q, q, nb)), na, nb)))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def query(spark, sf_dir):
    return linked(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """The document with the smallest doc_id of each component, in the columns of docs.

    Of rows that share its doc_id the one with the smallest text stays; rows
    with a null doc_id all stay.
    """
    found = materialize(linked(docs))
    gone, place = unused(docs, "gone"), unused(docs, "place")
    drop = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    # texts cross no shuffle while the ids to drop can be sent to every task
    drop = F.broadcast(drop) if drop.count() <= DROP_ROWS else drop
    out = docs.join(drop, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return out
    # null ids are spread by their texts
    turn = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")
    out = out.withColumn(place, F.row_number().over(turn)).filter((F.col(place) == 1) | F.col("doc_id").isNull())
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s)::BIGINT AS n, md5_number_lower(unnest(s)) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r(doc_id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least(m.root, s.doc_id), s.doc_id) AS component_id
FROM s LEFT JOIN m ON m.doc_id = s.doc_id
"""
