"""Suffix-array dedup: hash-compared suffix sort of texts' bytes.

Suffixes are ordered by a quicksort of strings. Two suffixes are compared by binary search, over prefix polynomial hashes,
for the length they share, and then by the next byte; equal neighbours in the order are windows that occur more than once.
What the hashes call equal is verified byte by byte. All groups of a round, and all comparisons of a step, are done
together on arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nivalis.llm import blocks as B
from nivalis.llm.blocks import U
from nivalis.llm.repeats import Contexts, covered, ranges, repeated
from nivalis.llm.tables import read

WINDOW, GRAM = 100, 24
BLOCK_BYTES = 8 << 20  # larger blocks send fewer messages, and what recurs in one is sent once
WINDOWS = 2_000_000  # that are sorted in one go, or one of each context
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def contexts(block: B.Block) -> Contexts:
    """Contexts of a block, made for some of its texts at a time."""
    parts, begins = [], np.flatnonzero(np.diff(block.starts // B.BLOCK_BYTES, prepend=-1)).tolist()
    for i, j in zip(begins, [*begins[1:], len(block.ids)], strict=True):
        begin, end, number = int(block.starts[i]), int(block.starts[j - 1] + block.sizes[j - 1]) + 1, np.arange(i, j, dtype=np.int32)
        text = np.repeat(number, block.sizes[i:j] + 1)
        text[block.starts[i:j] + block.sizes[i:j] - begin] = -1 - number  # what parts the texts is in none
        parts.append((Contexts(B.BYTES[block.bytes[begin:end]], text, WINDOW, GRAM), begin))
    c = Contexts.joined(parts)
    c.base = block.starts
    c.raw = c.text_of = lambda a, b: block.data[a:b]
    return c


class Suffixes:
    """Suffixes of `data`, of which the first `length` bytes count."""

    def __init__(self, data: np.ndarray, length: int = WINDOW):
        self.data, self.length, self.prefix = data, length, B.Prefix(B.BYTES[data])

    def _against(self, a: np.ndarray, p: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffixes equal others, `p`; and for the rest the bytes they share with these, `lo` at least."""
        sums, down = self.prefix.sums, self.prefix.down
        a_sum, a_down, p_sum, p_down = sums[a], down[a], sums[p], down[p]
        same = (sums[a + self.length] - a_sum) * a_down == (sums[p + self.length] - p_sum) * p_down
        rest = np.flatnonzero(~same)
        a, p, lo, a_sum, a_down, p_sum, p_down = (x[rest] for x in (a, p, lo, a_sum, a_down, p_sum, p_down))
        hi = np.full(len(a), self.length - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            equal = (sums[a + mid] - a_sum) * a_down == (sums[p + mid] - p_sum) * p_down
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
        return same, lo

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group; equal `group` values must be neighbours. Equal suffixes stay in order.

        A group is parted by what its members share with one of them and by the next byte. Members of a part share at least
        one byte more than those of its group, so that there are at most as many rounds as bytes, and mostly a few."""
        order, at = np.arange(len(start)), np.arange(len(start))
        part, shared = np.cumsum(np.diff(group, prepend=group[:1]) != 0), np.zeros(len(start), np.int64)
        while len(at):
            first = np.flatnonzero(np.diff(part, prepend=-1))
            size = np.diff(np.append(first, len(at)))
            alone = np.repeat(size == 1, size)
            if alone.any():
                at, part, shared = at[~alone], part[~alone], shared[~alone]
                continue
            number = np.repeat(np.arange(len(first)), size)
            mine = start[order[at]]
            pivot = mine[first + (size >> 1)][number]
            same, common = self._against(mine, pivot, shared)
            place = np.full(len(at), self.length << 8)  # before the pivot, equal to it, behind it
            rest = np.flatnonzero(~same)
            own, other = self.data[mine[rest] + common], self.data[pivot[rest] + common]
            place[rest] = np.where(own < other, common, 2 * self.length - common) << 8 | own
            key = number * (self.length << 10) + place
            by = np.argsort(key, kind="stable")
            order[at] = order[at[by]]
            key = key[by]
            more = np.zeros(len(at), np.int64)
            more[rest] = common + 1
            keep = ~same[by]
            at, shared, part = at[keep], more[by][keep], np.cumsum(np.diff(key, prepend=-1) != 0)[keep]
        return order


def _earliest(head: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of equal ones: smallest document and, in it, smallest start, for each member; and who has it."""
    begin = np.flatnonzero(head)
    count = np.diff(np.append(begin, len(head)))
    d = np.repeat(np.minimum.reduceat(doc, begin), count)
    p = np.where(doc == d, pos, np.iinfo(np.int64).max)
    p = np.repeat(np.minimum.reduceat(p, begin), count)
    who = np.where((doc == d) & (pos == p), np.arange(len(head)), len(head))
    return d, p, np.repeat(np.minimum.reduceat(who, begin), count)


def _exact(texts: list[bytes], doc: np.ndarray, pos: np.ndarray):
    """The same without hashes; only where a hash was found to be wrong."""
    seen: dict[bytes, tuple[int, int]] = {}
    keys = list(zip(doc.tolist(), pos.tolist(), strict=True))
    for t, (d, p) in zip(texts, keys, strict=True):
        for o in range(len(t) - WINDOW + 1):
            w = t[o : o + WINDOW]
            seen[w] = min(seen.get(w, (d, p + o)), (d, p + o))
    hit = [(i, o) for i, (t, (d, p)) in enumerate(zip(texts, keys, strict=True)) for o in range(len(t) - WINDOW + 1) if seen[t[o : o + WINDOW]] < (d, p + o)]
    hit = np.array(hit, np.int64).reshape(-1, 2)
    return ranges(hit[:, 0], hit[:, 1])


def locate(key, off, n, doc, pos, texts):
    """Windows of each context that also start earlier: in a smaller document, or earlier in the same one."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    s = Suffixes(data)
    # equal contexts: all but the earliest have nothing new
    full = B.mix64(s.prefix.spans(begin, begin + size)) ^ key ^ B.mix64(size.astype(U) << U(32) | off.astype(U))
    order = np.lexsort((pos, doc, full))
    head = np.ones(len(order), bool)
    head[1:] = full[order][1:] != full[order][:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    same = ~head & (doc[order] == doc[lead]) & (pos[order] == pos[lead])  # repeated rows: judged for themselves
    late = ~head & ~same
    if any(texts[i] != texts[j] for i, j in zip(order[late].tolist(), lead[late].tolist(), strict=True)):
        return _exact(texts, doc, pos)
    all_i, all_a, all_b = [order[late]], [np.zeros(late.sum(), np.int64)], [n[order[late]].astype(np.int64) - 1]
    rep = np.sort(order[head | same])
    # their windows, in groups of equal anchor and equal distance from it; some distances at a time where there are many windows
    off, n = off.astype(np.int64), n.astype(np.int64)
    far = int(off[rep].max()) + 1
    step = max(1, far * WINDOWS // max(int(n[rep].sum()), WINDOWS))
    for near in range(0, far, step):
        begins = np.maximum(off[rep] - near - step + 1, 0)
        many = np.maximum(np.minimum(off[rep] - near + 1, n[rep]) - begins, 0)
        c = np.repeat(rep, many)
        o = np.arange(len(c)) + np.repeat(begins - np.cumsum(many) + many, many)
        dist = off[c] - o
        by = np.lexsort((dist, key[c]))
        c, o, dist = c[by], o[by], dist[by]
        new = np.ones(len(c), bool)
        new[1:] = (key[c][1:] != key[c][:-1]) | (dist[1:] != dist[:-1])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        c, o, group = c[many], o[many], group[many]
        start = begin[c] + o
        rank = s.sort(start, group)
        c, o, start, group = c[rank], o[rank], start[rank], group[rank]
        h = s.prefix.spans(start, start + WINDOW)
        head = np.ones(len(c), bool)
        head[1:] = (group[1:] != group[:-1]) | (h[1:] != h[:-1])
        if head.all():
            continue
        d, p, who = _earliest(head, doc[c], pos[c] + o)
        hit = np.flatnonzero((doc[c] > d) | (pos[c] + o > p))
        if not len(hit):
            continue
        hit = hit[np.lexsort((o[hit], c[hit]))]
        # runs of windows whose earlier equals are neighbours too are verified as one span
        i, x, j, y = c[hit], o[hit], c[who[hit]], o[who[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (i[1:] != i[:-1]) | (x[1:] != x[:-1] + 1) | (j[1:] != j[:-1]) | (y[1:] != y[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(hit)) - 1
        spans = zip((begin[i[a]] + x[a]).tolist(), (begin[j[a]] + y[a]).tolist(), (x[b] - x[a] + WINDOW).tolist(), strict=True)
        if any(joined[u : u + z] != joined[v : v + z] for u, v, z in spans):
            return _exact(texts, doc, pos)
        i, a, b = ranges(i, x)
        all_i, all_a, all_b = [*all_i, i], [*all_a, a], [*all_b, b]
    return np.concatenate(all_i), np.concatenate(all_a), np.concatenate(all_b)


def _kept(block: B.Block, replies: list[bytes]):
    gone = covered(len(block.data), replies)
    out = [[], [], [], [], []]
    for i, (s, size) in enumerate(zip(block.starts.tolist(), block.sizes.tolist(), strict=True)):
        text, spans = block.data[s : s + size], 0
        own = gone[s : s + size]
        if n := int(np.count_nonzero(own)):
            spans = len(B.runs(own)[0])
            text = block.bytes[s : s + size][~own].tobytes()
        for column, x in zip(out, (block.id(i), size, n, spans, hashlib.sha256(text).hexdigest()), strict=True):
            column.append(x)
    yield out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text's UTF-8 bytes but those covered by WINDOW bytes
    that also start earlier, in a document of smaller id or earlier in the same one; overlaps count.

    A null text is empty; shorter texts are kept; a null doc_id counts as the largest. Rows of equal doc_id are taken
    for one document. Other columns are left out; an empty table gives an empty result."""
    blocks = repeated(B.pack(docs, size=BLOCK_BYTES), contexts, locate, WINDOW)
    return B.each(blocks, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _OUT)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
