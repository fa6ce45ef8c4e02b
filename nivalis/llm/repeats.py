"""Windows of tokens (words or bytes) that start elsewhere too: how op2 finds them, and what op7 shares of it.

Each window of LENGTH tokens has an anchor: the smallest hash of its grams, the rightmost of equal ones. Equal windows
have equal anchors, so blocks first ask which anchors occur more than once, and then, for those alone, send the text of
all windows that have the anchor (neighbouring windows mostly share it) to the anchor's bucket, where exact texts are
compared. Hashes only choose what is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from nivalis.llm import blocks as B
from nivalis.llm.blocks import U, Block, Prefix, dump, load

AT_ONCE = 20_000  # contexts that are compared in one go
KINDS = (U, np.int64, np.int64, np.int32, np.int32, np.int32)  # of a message's columns


def _anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """Of each w consecutive hashes, where the one with the smallest upper half is; the rightmost of equal ones. It depends on
    these w alone."""
    low = U(0xFFFFFFFF)
    least, width = grams & ~low | (low - np.arange(len(grams), dtype=U)), 1
    while width < w:
        step = min(width, w - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    return (low - (least & low)).astype(np.int64)


class Contexts:
    """Of a block: `key` (the anchor's hash), `first` and `last` window start, `anchor`, `text` (the document's index), `whole`
    (a hash of all its tokens)."""

    def __init__(self, values: np.ndarray, of_text: np.ndarray, length: int, gram: int):
        prefix = Prefix(values)
        n = len(values) - length + 1
        none = np.zeros(0, np.int64)
        self.key, self.first, self.last, self.anchor, self.text, self.whole = none.astype(U), none, none, none, none, none.astype(U)
        if n <= 0:
            return
        grams = prefix.all(gram)
        B.mix64(grams, grams)
        grams &= ~U(1)
        anchor = _anchors(grams, length - gram + 1)
        whole = of_text[:n] == of_text[length - 1 :]  # the window is within one text
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (of_text[1:n] != of_text[: n - 1])
        self.first = np.flatnonzero(new & whole)
        ends = np.flatnonzero(np.append(new[1:], True) | np.append(~whole[1:], True))
        self.last = ends[np.searchsorted(ends, self.first)]
        self.anchor = anchor[self.first]
        self.key, self.text = grams[self.anchor], of_text[self.first]
        self.whole = prefix.spans(self.first, self.last + length)

    @classmethod
    def joined(cls, parts: list[tuple[Contexts, int]]) -> Contexts:
        """Those of a block's parts, which begin at the given tokens."""
        out = cls.__new__(cls)
        for name, moves in (("key", 0), ("first", 1), ("last", 1), ("anchor", 1), ("text", 0), ("whole", 0)):
            setattr(out, name, np.concatenate([getattr(c, name) + begin if moves else getattr(c, name) for c, begin in parts]))
        return out


def _count(contexts: Callable) -> Callable:
    def question(block: Block, _, n: int):
        key, times = np.unique(contexts(block).key, return_counts=True)
        for bucket, at in B.split(n, key):
            yield bucket, 0, (key[at] | (times[at] > 1)).tobytes()

    return question


def _recurring(got: list) -> Iterator[tuple]:
    keys = [np.frombuffer(x[3], U) for x in got]
    block = np.repeat([x[1] for x in got], [len(k) for k in keys])
    key = np.concatenate(keys)
    del keys
    multi, key = (key & U(1)).astype(bool), key & ~U(1)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times > 1
    again[inverse[multi]] = True
    hit = again[inverse]
    block, key = block[hit], key[hit]
    order = np.lexsort((key, block))
    block, key = block[order], key[order]
    first = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=False):
        yield 0, int(block[a]), 0, key[a:b].tobytes()


def among(c: Contexts, replies: list[bytes]) -> np.ndarray:
    """Which contexts have an anchor that recurs."""
    known = np.sort(np.concatenate([np.frombuffer(x, U) for x in replies])) if replies else np.zeros(0, U)
    if not len(known) or not len(c.key):
        return np.zeros(0, np.int64)
    found = np.minimum(np.searchsorted(known, c.key), len(known) - 1)
    return np.flatnonzero(known[found] == c.key)


def together(key: np.ndarray) -> Iterator[np.ndarray]:
    """Where keys are, equal ones together, about AT_ONCE at a time."""
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] ^ U(1)))
    a = 0
    while a < len(order):
        k = np.searchsorted(begins, a + AT_ONCE, "right") - 1
        b = len(order) if a + AT_ONCE >= len(order) else int(begins[k]) if begins[k] > a else int(begins[k + 1]) if k + 1 < len(begins) else len(order)
        yield order[a:b]
        a = b


def _message(length: int, texts: list[bytes], *columns: np.ndarray) -> bytes:
    """Contexts (key, doc, pos, off, n, first) with their texts, which have n + length - 1 bytes."""
    head = [np.array([len(texts)])] + [c.astype(t) for c, t in zip(columns, KINDS, strict=True)]
    return B.squeezed(b"".join([*[c.tobytes() for c in head], *texts]))


def _contexts_of(length: int, blob: bytes) -> list:
    raw = B.unsqueezed(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in KINDS:
        out.append(np.frombuffer(raw, t, n, at))
        at += out[-1].nbytes
    ends = at + np.cumsum(out[4].astype(np.int64) + length - 1)
    return [*out, [raw[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist(), strict=False)]]


def _send(contexts: Callable, length: int) -> Callable:
    def question(block: Block, replies: list[bytes], n: int):
        c = contexts(block)
        take = among(c, replies)
        if not len(take):
            return
        first, end, key, doc, anchor = c.first[take], c.last[take] + length, c.key[take], block.ids[c.text[take]], c.anchor[take]
        pos = first - c.base[c.text[take]]
        full = B.mix64(c.whole[take]) ^ key ^ B.mix64((end - first).astype(U))
        # equal contexts within the block are sent once, for the first of them
        order = np.lexsort((pos, doc, full))
        head = np.ones(len(order), bool)
        head[1:] = full[order][1:] != full[order][:-1]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        send, local = [order[head]], []
        later = ~head & ((doc[order] > doc[lead]) | (pos[order] > pos[lead]))
        for i, j in zip(order[later].tolist(), lead[later].tolist(), strict=True):
            (local if c.text_of(first[i], end[i]) == c.text_of(first[j], end[j]) else send).append(i)
        own = [np.array(local, np.int64), order[~head & ~later]]
        send = np.sort(np.concatenate([send[0], np.array(send[1:], np.int64), own[1]]))
        if len(own[0]):
            yield int(block.block % n), 1, dump(np.stack([first[own[0]], end[own[0]]]))
        for bucket, at in B.split(n, key[send]):
            at = send[at]
            text = [c.raw(first[i], end[i]) for i in at.tolist()]
            yield bucket, 0, _message(length, text, key[at], doc[at], pos[at], anchor[at] - first[at], end[at] - first[at] - length + 1, first[at])

    return question


def _compare(resolve: Callable, length: int) -> Callable:
    """`resolve(key, off, n, doc, pos, texts)` returns rows (context, first and last window that starts earlier elsewhere)."""

    def reply(got: list) -> Iterator[tuple]:
        sent = []
        for _, block, kind, blob in got:
            if kind == 1:
                yield 0, block, 1, blob
            else:
                sent.append((block, *_contexts_of(length, blob)))
        if not sent:
            return
        block = np.repeat([x[0] for x in sent], [len(x[1]) for x in sent])
        key, doc, pos, off, n, first = (np.concatenate([x[k] for x in sent]) for k in range(1, 7))
        texts = [t for x in sent for t in x[7]]
        del sent
        out: dict[int, list] = {}
        for at in together(key):
            i, o1, o2 = resolve(key[at], off[at], n[at], doc[at], pos[at], [texts[j] for j in at.tolist()])
            i = at[i]
            for blk, x, y in zip(block[i].tolist(), (first[i] + o1).tolist(), (first[i] + o2 + length).tolist(), strict=True):
                out.setdefault(blk, []).append((x, y))
        for blk, spans in out.items():
            yield 0, blk, 0, dump(np.array(spans, np.int64).T)

    return reply


def with_anchors(blocks: DataFrame, contexts: Callable, n: int) -> DataFrame:
    """Blocks that hold recurring anchors, and which, as `replies`; n buckets are asked."""
    return B.told(blocks, B.answer(B.ask(blocks, _count(contexts), n), _recurring), "inner")


def repeated(blocks: DataFrame, contexts: Callable, resolve: Callable, length: int) -> DataFrame:
    """Blocks with `replies`: dumped arrays of starts and ends of tokens covered by a window that starts earlier too, in a
    document of smaller id or in the same one."""
    n = B.buckets(blocks.sparkSession, blocks.count(), 2)
    asked = B.ask(with_anchors(blocks, contexts, n), _send(contexts, length), n)
    return B.told(blocks, B.answer(asked, _compare(resolve, length)))


def covered(n_tokens: int, replies: list[bytes]) -> np.ndarray:
    depth = np.zeros(n_tokens + 1, np.int32)
    for x in replies:
        (spans,) = load(x)
        np.add.at(depth, spans[0], 1)
        np.subtract.at(depth, spans[1], 1)
    return np.cumsum(depth, out=depth)[:-1] > 0


def ranges(context: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (context, number), sorted, as runs (context, first, last)."""
    new = np.ones(len(at), bool)
    new[1:] = (context[1:] != context[:-1]) | (at[1:] != at[:-1] + 1)
    begin, end = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)[: len(at)])
    return context[begin], at[begin], at[end]
