"""LM scoring by logistic context mixing of bit predictors.

A text is a sequence of symbols: a known word (one that training texts have at least twice), UNKNOWN for any other word,
and END. A symbol is written in bits: Huffman code of its class (by the word's first and last bytes, 256 of them), Huffman
code of its group in the class, and a code of the word in the group; only bits at which the code branches are written. Each
bit is predicted: the counts of zeros and ones that each context has seen there (all symbols; the classes of each of three
words before; the word before; the two words before) are log odds, which are combined by weights that a gate chooses, and the
result is refined by an adaptive table. An UNKNOWN word is spelled, and the bits of its bytes are predicted in the same way
from one to four bytes before them. The log of the product of all is the text's score; divided by its bytes it is its bits
per byte.

What is learnt covers all training texts. Counts of words, and of pairs of a context and the symbol that follows, are
summed in buckets by hash and told to the blocks that ask for them; they grow with the corpus, and contexts are told apart
by hashes that grow with it too. Weights and refinements are trained online, in each block from the same beginning, on the
summed counts without the symbol at hand, and are averaged over blocks; scores are taken with all counts. A block's texts are
chosen by a hash of the row, so that scores depend on the table alone and not on how its rows are dealt.
"""

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import blocks as B
from nivalis.llm.blocks import U, dump, load
from nivalis.llm.tables import read, written
from nivalis.session import new_path, remove, short_shuffles

CLASSES = 256
SUBS = 16  # groups of a class
UNKNOWN, END, START = CLASSES, CLASSES + 1, CLASSES + 2
KINDS = CLASSES + 2  # classes, UNKNOWN and END
BLOCK_BYTES = 4 << 20
PARTS = 8  # of the blocks, and of the buckets; one after another
STEP = 1 << 13  # symbols or bytes that are predicted with the same weights
PRIOR = 0.4
CELLS = 24
CODE_BITS = 40
WORDS_OF_CLASS, WORDS = 3, 2  # contexts of single classes, and of one and two words
ORDERS = 4  # contexts of bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

# ---- counts as states ----------------------------------------------------------------------------------------------

#: A count's level is the last of these that it reaches; a level stands for the count in MIDDLE.
LEVELS = np.array([0, 1, 2, 3, 4, 5, 7, 10, 15, 23, 41, 81, 201, 601, 2001, 10001])
MIDDLE = np.array([0, 1, 2, 3, 4, 5.5, 8, 12, 18, 31, 58, 130, 350, 1100, 4500, 30000])
_LEVEL = (np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), "right") - 1).astype(np.uint8)
#: A state is 16 times the level of the bit's value plus the level of the other.
ODDS = np.log((MIDDLE[:, None] + PRIOR) / (MIDDLE + PRIOR)).ravel().astype(np.float32)
_SURE = np.maximum(np.arange(256) >> 4, np.arange(256) & 15)
#: How sure two contexts are, in eight and in four steps, chooses the gate.
GATE = (np.array([0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 7], np.uint8)[_SURE] * np.uint8(4), np.array([0, 1, 1, 2, 2, 2, 3], np.uint8)[np.minimum(_SURE, 6)])
#: The same without the bit at hand; a count above 6 stays as it is.
_OTHERS = (np.array([0, 0, 1, 2, 3, 4, *range(6, 16)])[:, None] * 16 + np.arange(16)).ravel()
ODDS_OF_OTHERS, GATE_OF_OTHERS = ODDS[_OTHERS], tuple(x[_OTHERS] for x in GATE)
FINE = 8  # steps of the log odds of all symbols, to a nat
UNIT = 1 << 24  # a score is a sum of logarithms in multiples of 1 / UNIT, which is exact in any order: equal texts have equal scores wherever they lie in a block


def level(counts: np.ndarray) -> np.ndarray:
    return _LEVEL.take(np.minimum(counts, LEVELS[-1]))


def state(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The state of two counts. Where one is beyond the last level, both are made smaller by the same factor, so that it is their
    ratio that counts, however large they are."""
    scale = np.minimum(1, MIDDLE[-1] / np.maximum(np.maximum(own, other), 1))
    small = (np.rint(np.maximum(x * scale, np.minimum(x, 1))).astype(np.int64) for x in (own, other))
    high, low = (level(x) for x in small)
    return high << 4 | low


def fine(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(FINE * np.log(np.maximum(own, PRIOR) / np.maximum(other, PRIOR))), -127, 127).astype(np.int8)


# ---- codes ---------------------------------------------------------------------------------------------------------


def huffman(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of at most some 16 bits, from the left of 64, and their lengths; none where there is no mass."""
    code, length = np.zeros(len(mass), U), np.zeros(len(mass), np.int64)
    heap = [(max(int(m), int(mass.sum()) >> 13), i, [i]) for i, m in enumerate(mass) if m > 0]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, a[2]), (1, b[2])):
            code[side] = code[side] >> U(1) | U(bit << 63)
            length[side] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return code, length


def shannon(group: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A prefix code in each group, from the left of 64 bits. Rows are in order of group and falling count."""
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(edges, append=len(group))
    if not len(edges):
        return np.zeros(0, U)
    c = counts.astype(np.int64)
    total = np.repeat(np.add.reduceat(c, edges), sizes)
    c = np.maximum(c >> np.maximum(np.ceil(np.log2(total + 1)).astype(np.int64) - 18, 0), 1)
    total = np.repeat(np.add.reduceat(c, edges), sizes)
    ahead = np.cumsum(c) - c
    ahead -= np.repeat(ahead[edges], sizes)
    length = np.ceil(np.log2(total / c)).astype(np.int64)
    length += (c << length) < total
    return np.where(length > 0, ((ahead << length) // total).astype(U) << (U(64) - np.maximum(length, 1).astype(U)), U(0))


def walk(key: np.ndarray, code: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth: rows of which another row of the same key has the same first bits; the sum of counts of the rows
    with these bits; and of those that have the next bit too. Rows are distinct and in order of key and code, and codes
    have at most CODE_BITS."""
    if not len(code):
        return
    differ = ((code[1:] ^ code[:-1]) >> U(64 - CODE_BITS)).astype(np.float64)
    common = np.full(len(code) + 1, -1, np.int8)
    common[1:-1] = np.where(key[1:] == key[:-1], CODE_BITS - np.frexp(differ)[1], -1)
    alone = np.maximum(common[:-1], common[1:]) + 1
    rows = np.flatnonzero(alone > 0)
    depth = 0
    while len(rows):
        c, own = common[rows], counts[rows]
        sums = []
        for d in (depth, depth + 1):
            edges = np.flatnonzero(c < d)
            sums.append(np.repeat(np.add.reduceat(own, edges), np.diff(edges, append=len(rows))))
        yield depth, rows, *sums
        depth += 1
        rows = rows[alone[rows] > depth]


class Heads:
    """What all blocks know: codes of classes, groups, UNKNOWN and END, and the counts on the way to them.

    Rows: the groups of words; UNKNOWN; END. `classes` has the codes of classes, UNKNOWN and END alone."""

    def __init__(self, mass: np.ndarray, single: int, texts: int):
        mass = np.concatenate((mass, [single, texts]))
        cls = np.concatenate((np.repeat(np.arange(CLASSES), SUBS), [UNKNOWN, END]))
        whole = np.bincount(cls, mass, KINDS).astype(np.int64)
        whole[CLASSES:] += 1
        self.classes, self.class_length = huffman(whole)
        group, size = np.zeros(len(mass), U), np.zeros(len(mass), np.int64)
        for c in np.flatnonzero(whole[:CLASSES]):
            at = slice(c * SUBS, c * SUBS + SUBS)
            group[at], size[at] = huffman(mass[at])
        self.cls, self.mass = cls, np.maximum(mass, 1)
        self.code = self.classes[cls] | group >> self.class_length[cls].astype(U)
        self.length = self.class_length[cls] + size
        self.low, self.high = np.zeros((2, int(self.length.max(initial=0)) + 1, len(mass)), np.int64)
        there = np.flatnonzero((mass > 0) | (cls >= CLASSES))
        there = there[np.argsort(self.code[there])]
        for depth, rows, low, high in walk(np.zeros(len(there)), self.code[there], self.mass[there]):
            self.low[depth, there[rows]], self.high[depth, there[rows]] = low, high


# ---- words ---------------------------------------------------------------------------------------------------------


def is_held_out(doc_id: int) -> bool:
    return doc_id != B.NO_ID and zlib.crc32(str(doc_id).encode()) % 7 == 2


def order_of(keys: np.ndarray) -> np.ndarray:
    """Order of 64-bit keys. Sorting keys with their places in the last bits is faster than sorting places; keys that differ in
    those bits alone are then put in order among themselves."""
    bits = U(max(len(keys) - 1, 1).bit_length())
    packed = keys >> bits << bits | np.arange(len(keys), dtype=U)
    packed.sort()
    packed &= (U(1) << bits) - U(1)
    order = packed.view(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):
        top = found >> bits
        group = np.zeros(len(keys), np.int32)
        np.cumsum(top[1:] != top[:-1], out=group[1:])
        del top
        at = np.flatnonzero(np.isin(group, group[wrong]))
        order[at] = order[at][np.lexsort((found[at], group[at]))]
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the first of each distinct key is, in order of key; which of them each key is)."""
    bits = max(len(keys) - 1, 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 64:
        order = order_of(keys)
        found = keys[order]
    else:
        found = keys << U(bits) | np.arange(len(keys), dtype=U)
        found.sort()
        order = (found & U((1 << bits) - 1)).view(np.int64)
        found >>= U(bits)
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def joined(upper: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """One key of two, the second below `n`, of as few bits as hold them."""
    return upper << U(max(n - 1, 1).bit_length()) | lower


def _planes(x: np.ndarray, n: int) -> bytes:
    """The first n bytes of each number, first bytes first, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :n].T).tobytes()


def _joined(planes: bytes, n: int, kind: type) -> np.ndarray:
    size = len(planes) // n
    out = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    out[:, :n] = np.frombuffer(planes, np.uint8).reshape(n, size).T
    return out.view(kind).reshape(-1)


class Tokens:
    """A block's words: hash, class, text; and for each text whether it is held out."""

    def __init__(self, block: B.Block):
        self.bytes = LOWER[block.bytes]
        self.start, self.end, self.text = block.words()
        self.hash = B.mix64(B.Prefix(B.BYTES[self.bytes]).spans(self.start, self.end))
        self.held = np.fromiter((is_held_out(i) for i in block.ids.tolist()), bool, len(block.ids))
        first, self.which = distinct(self.hash)
        self.distinct = self.hash[first]
        last = self.end - 1
        ends = self.bytes[last].astype(U) | self.bytes[np.maximum(last - 1, self.start)].astype(U) << U(8) | self.bytes[self.start].astype(U) << U(16)
        self.cls = (B.mix64(ends) & U(CLASSES - 1)).astype(np.int64)
        self.group = self.cls[first] * SUBS + (self.distinct & U(SUBS - 1)).astype(np.int64)

    def buckets(self, n: int):
        """A group of words is whole in a bucket."""
        return B.split(n, B.mix64(self.group.astype(U) + U(11)))

    def told(self, replies: list[bytes]) -> None:
        """Of each distinct word: its count in all training texts, its code in its group, and its odds on the way."""
        d = len(self.distinct)
        self.counts, self.tail, self.tail_length = np.zeros(d, np.int64), np.zeros(d, U), np.zeros(d, np.int64)
        asked: dict | None = None
        odds: list[np.ndarray] = []
        for kind, *x in map(load, replies):
            if kind != "words":
                continue
            n, bucket, counts, tail, length, deep = x
            asked = asked or dict(self.buckets(n))
            at = asked[bucket]
            self.counts[at], self.tail[at], self.tail_length[at] = counts, _joined(tail, 4, np.uint64) << U(32), length
            for depth, got in enumerate(deep):
                if depth == len(odds):
                    odds.append(np.zeros(d, np.int8))
                odds[depth][at[length > depth]] = np.frombuffer(got, np.int8)
        self.odds = odds


def _words(block: B.Block, _, n: int):
    t = Tokens(block)
    counts = np.bincount(t.which, ~t.held[t.text], len(t.distinct))
    for bucket, at in t.buckets(n):
        yield bucket, 0, dump(n, _planes(t.distinct[at], 8), counts[at].astype(np.uint32), t.group[at].astype(np.uint16))
    yield int(block.block % n), 1, dump(int((~t.held).sum()))


def _sum(got: list):
    """Of a bucket's groups: counts of words, and codes of the known ones."""
    texts = sum(load(x[3])[0] for x in got if x[2] == 1)
    sent = [(x[0], x[1], *load(x[3])) for x in got if x[2] == 0]
    mass: tuple = ([], [])
    stats = [0, 0, 0]
    if sent:
        keys = np.concatenate([_joined(x[3], 8, np.uint64) for x in sent])
        first, which = distinct(keys)
        group = np.concatenate([x[5] for x in sent])[first]
        counts = np.bincount(which, np.concatenate([x[4] for x in sent])).astype(np.int64)
        stats = [int((counts > 0).sum()), int(counts.sum()), int((counts == 1).sum())]
        known = np.flatnonzero(counts > 1)
        known = known[np.lexsort((-counts[known], group[known]))]
        code = shannon(group[known].astype(np.int64), counts[known])
        order = np.lexsort((code, group[known]))
        known, code = known[order], code[order]
        # only bits at which the code branches are kept
        tail, length = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
        odds: list[np.ndarray] = []
        for depth, rows, low, high in walk(group[known], code, counts[known]):
            fork = high < low
            rows, low, high = rows[fork], low[fork], high[fork]
            w, bit = known[rows], code[rows] >> U(63 - depth) & U(1)
            at = length[w]
            tail[w] |= bit << (U(63) - at.astype(U))
            for k in np.unique(at):
                if k == len(odds):
                    odds.append(np.zeros(len(counts), np.int8))
                odds[k][w[at == k]] = fine(high[at == k], (low - high)[at == k])
            length[w] += 1
        groups, at = np.unique(group[known], return_inverse=True)
        mass = (groups, np.bincount(at, counts[known], len(groups)).astype(np.int64))
        at = 0
        for bucket, block, n, own, *_ in sent:
            w = which[at : at + len(own) // 8]
            at += len(w)
            deep = [x[w[length[w] > k]].tobytes() for k, x in enumerate(odds)]
            yield 0, block, 0, dump("words", n, bucket, counts[w].astype(np.uint32), _planes(tail[w] >> U(32), 4), length[w].astype(np.uint8), deep)
    yield 0, -1, 2, dump(texts, *stats, *mass)


# ---- contexts ------------------------------------------------------------------------------------------------------


def _before(values: np.ndarray, text: np.ndarray, back: int, start) -> np.ndarray:
    """The value `back` places before, in the same text; else `start`."""
    out = np.full(len(values), start, values.dtype)
    if len(values) > back:
        out[back:] = np.where(text[back:] == text[:-back], values[:-back], out[back:])
    return out


class Sequence:
    """What is to be predicted in a block, and what it asks about contexts.

    `symbol` has, for each word and each text's end, a row of `code` and `length`: distinct words, UNKNOWN and END; `own` says
    whether it is in the counts. `byte` has the bytes of the words that are spelled. `pairs` are, for each context of
    symbols and then of bytes, which of its pairs is at each of them (at each of `some_bytes`, which `of_some` has for each byte); `at`,
    where to find what is told about them."""

    def __init__(self, block: B.Block, replies: list[bytes], heads: Heads):
        t = self.t = Tokens(block)
        t.told(replies)
        self.heads = heads
        n, d = len(block.ids), len(t.distinct)
        self.head = np.concatenate((t.group, [CLASSES * SUBS, CLASSES * SUBS + 1]))
        self.head_length = heads.length[self.head]
        self.code = heads.code[self.head]
        self.code[:d] |= t.tail >> self.head_length[:d].astype(U)
        self.length = self.head_length.copy()
        self.length[:d] += t.tail_length
        word = np.arange(len(t.text)) + t.text  # places of words; an END comes after each text's
        end = np.searchsorted(t.text, np.arange(n), "right") + np.arange(n)

        def ended(of_words, of_ends):
            out = np.empty(len(word) + n, np.int64)
            out[word], out[end] = of_words, of_ends
            return out

        known = t.counts[t.which] > 1
        self.text = ended(t.text, np.arange(n))
        self.symbol = ended(np.where(known, t.which, d), d + 1)
        self.own = ~t.held[self.text]
        self.cls = heads.cls[self.head]
        self.class_length = heads.class_length[self.cls]
        parts = [*self._classes(ended(t.cls, END)), *self._words(ended(t.which, d))]
        self._spelled(np.flatnonzero(~known))
        parts += self._bytes()
        self.pairs = [x[3] for x in parts]
        self.edges = np.cumsum([0, *(len(x[0]) for x in parts)])
        self.asked = [np.concatenate([x[k] for x in parts]) for k in range(3)]  # context, code, own count
        del t.bytes, t.start, t.end, t.hash, t.cls, self.place

    def _classes(self, cls: np.ndarray):
        """(context, code, count, pair before each symbol) of pairs of a class and the class of the symbol."""
        to = self.cls[self.symbol]
        for back in range(1, WORDS_OF_CLASS + 1):
            x = _before(cls, self.text, back, START) * KINDS + to
            there = np.flatnonzero(np.bincount(x, minlength=(START + 1) * KINDS))
            number = np.zeros((START + 1) * KINDS, np.int64)
            number[there] = np.arange(len(there))
            yield B.mix64((there // KINDS).astype(U) + U(back << 32)), self.heads.classes[there % KINDS], np.bincount(number[x], self.own, len(there)), number[x]

    def _words(self, word: np.ndarray):
        """The same of pairs of one or two words and the symbol. A word is the number of a distinct one; END and no word are the last."""
        d = len(self.t.distinct)
        one, two = _before(word, self.text, 1, d + 1), _before(word, self.text, 2, d + 2)
        hashes = np.concatenate((self.t.distinct, np.array([7, 3, 5], U)))
        rank = np.empty(len(self.code), U)
        rank[np.argsort(self.code)] = np.arange(len(self.code), dtype=U)
        symbol = rank[self.symbol]
        of_one = B.mix64(hashes + U(101))
        of_two = B.mix64((hashes * U(3))[one] + B.mix64(hashes + U(102))[two])
        for context, number in ((of_one[one], distinct(of_one)[1][one]), (of_two, distinct(of_two)[1])):
            first, which = distinct(joined(number.astype(U), symbol, len(rank)))
            yield context[first], self.code[self.symbol[first]], np.bincount(which, self.own, len(first)), which

    def _spelled(self, words: np.ndarray) -> None:
        """Bytes of the words at hand, each with the space that ends it."""
        t = self.t
        size = t.end[words] - t.start[words] + 1
        w = np.repeat(words, size)
        self.place = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        at = np.minimum(t.start[w] + self.place, len(t.bytes) - 1)
        self.byte = np.where(self.place == np.repeat(size, size) - 1, 0x20, t.bytes[at]).astype(np.int64)
        self.byte_text, self.byte_own = t.text[w], ~t.held[t.text[w]]

    def _bytes(self):
        """The same of pairs of one to four bytes before, in the word, and the byte. The last of them tell all others."""
        before = [np.zeros(len(self.byte), U)]
        for back in range(1, ORDERS + 1):
            inside = self.place >= back
            last = np.full(len(self.byte), 0x20, U)
            last[inside] = self.byte[np.flatnonzero(inside) - back]
            before.append(before[-1] << U(8) | last)
        some, of = distinct(joined(before[-1], self.byte.astype(U), 256))
        byte, own = self.byte[some].astype(U), np.bincount(of, self.byte_own, len(some))
        self.some_bytes, self.of_some = some, of
        for back in range(1, ORDERS + 1):
            x = before[back][some]
            first, which = distinct(joined(x, byte, 256))
            yield B.mix64(x[first] + U((200 + back) << 40)), byte[first] << U(56), np.bincount(which, own, len(first)), which

    def _buckets(self, n: int):
        """Pairs in order of the bucket of their context, and (bucket, from, to)."""
        bucket = (self.asked[0] >> U(32)) * U(n) >> U(32)
        order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.uint64), kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
        return order, [*zip(bucket[order[edges]].tolist(), edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True)]

    def ask(self, n: int, bits: int):
        order, buckets = self._buckets(n)
        context, code, count = (x[order] for x in self.asked)
        context >>= U(64 - bits)
        new = np.ones(len(order), bool)
        new[1:] = context[1:] != context[:-1]
        for bucket, a, b in buckets:
            new[a] = True
            x = context[a:b][new[a:b]]
            yield bucket, 0, dump(n, np.packbits(new[a:b]).tobytes(), _planes(np.diff(x, prepend=U(0)), 8), _planes(code[a:b] >> U(64 - CODE_BITS), 5), _planes(count[a:b].astype(np.uint32), 4))

    def told(self, replies: list[bytes]) -> None:
        """`states` has, for each pair and depth, what the pair's context has seen there; in the last column, what it has deeper."""
        got = [x[1:] for x in map(load, replies) if x[0] == "contexts"]
        size = len(self.asked[0])
        last, deep, self.odds = np.zeros(size, np.uint8), np.zeros(size, np.uint8), []
        self.at = np.arange(size)
        if got:
            order, buckets = self._buckets(got[0][0])
            self.at[order] = np.arange(size)
            del order
            at = {bucket: slice(a, b) for bucket, a, b in buckets}
            for _, bucket, deeper, depths, _ in got:
                last[at[bucket]], deep[at[bucket]] = np.frombuffer(deeper, np.uint8), np.frombuffer(depths, np.uint8)
        self.asked = []
        self.states = np.repeat(last, int(deep.max(initial=0)) + 1).reshape(size, -1)
        for _, bucket, _, _, states in got:
            rows, own = deep[at[bucket]], self.states[at[bucket]].reshape(-1)
            there = np.arange(len(rows))
            for depth, x in enumerate(states):
                there = there[rows[there] > depth]
                own[there * self.states.shape[1] + depth] = np.frombuffer(x, np.uint8)
        h, head, tail = self.heads, self.head, self.length - self.head_length
        for depth in range(len(h.low)):
            self.odds.append(fine(h.high[depth], h.low[depth] - h.high[depth])[head])
        self.odds += [np.zeros(len(head), np.int8) for _ in range(int(self.length.max()) - len(self.odds))]
        for k, x in enumerate(self.t.odds):
            rows = np.flatnonzero(tail[: len(x)] > k)
            for depth in np.unique(self.head_length[rows] + k):
                r = rows[self.head_length[rows] + k == depth]
                self.odds[depth][r] = x[r]

    def _seen(self, k: int, rows: np.ndarray, depths: int) -> np.ndarray:
        """For each depth, what is told about the rows' pairs of the k-th context."""
        told = self.states.take(self.at[self.edges[k] : self.edges[k + 1]], 0)
        if depths < told.shape[1] - 1:
            told[:, depths] = told[:, -1]
            told = np.ascontiguousarray(told[:, : depths + 1])
        return np.ascontiguousarray(told.take(self.pairs[k].take(rows), 0, mode="clip").T)

    def symbol_bits(self, learn: bool) -> Iterator["Bits"]:
        """Bits of the class, of which all contexts know something, and bits of the word, of which some do."""
        rows = np.flatnonzero(self.own) if learn else np.arange(len(self.symbol))
        symbol, text = self.symbol[rows], self.text[rows]
        code, length, class_length = self.code[symbol], self.length.astype(np.uint8)[symbol], self.class_length.astype(np.uint8)[symbol]
        deepest, deepest_class = int(length.max(initial=0)), int(class_length.max(initial=0))
        seen = [self._seen(k, rows, deepest_class if k < WORDS_OF_CLASS else deepest) for k in range(WORDS_OF_CLASS + WORDS)]
        odds = np.ascontiguousarray(np.stack(self.odds[:deepest], 1).take(symbol, 0).T) if deepest else np.zeros((0, 0), np.int8)
        for depth in range(deepest):
            of_class = class_length > depth
            here = [x[min(depth, len(x) - 1)] for x in seen]
            for kind, part, states in (("class", of_class, here), ("word", (length > depth) & ~of_class, here[WORDS_OF_CLASS:])):
                for at in _steps(part):
                    yield Bits(kind, depth, code[at], text, at, learn, [x[at] for x in states], odds[depth][at])

    def byte_bits(self, learn: bool) -> Iterator["Bits"]:
        """Bits of the bytes to learn from; to score, of each of the longest pairs once, as if it were a text."""
        rows = np.flatnonzero(self.byte_own) if learn else self.some_bytes
        code, text, some = self.byte[rows].astype(U) << U(56), np.arange(len(rows)), self.of_some[rows]
        seen = [self._seen(k, some, 8) for k in range(len(self.pairs) - ORDERS, len(self.pairs))]
        for depth in range(8):
            here = [x[min(depth, len(x) - 1)] for x in seen]
            for at in _steps(np.ones(len(rows), bool)):
                yield Bits("byte", depth, code[at], text, at, learn, [x[at] for x in here])


def _steps(flags: np.ndarray) -> Iterator[slice | np.ndarray]:
    """Where flags are True, STEP at a time."""
    if flags.all():
        yield from (slice(a, a + STEP) for a in range(0, len(flags), STEP))
    else:
        rows = np.flatnonzero(flags)
        yield from (rows[a : a + STEP] for a in range(0, len(rows), STEP))


# ---- mixing --------------------------------------------------------------------------------------------------------

INPUTS = {"class": 1 + WORDS_OF_CLASS + WORDS, "word": 1 + WORDS, "byte": ORDERS}
GATES = 32
PREFIX = 9  # so many bits before this one, if there are no more, choose the place of the refinement
_FINE = (np.arange(256, dtype=np.uint8).view(np.int8) / FINE).astype(np.float32)


class Bits:
    """Bits of one depth: the log odds that each context gives their values, which gate chooses the weights, the place of
    the refinement."""

    def __init__(self, kind: str, depth: int, code: np.ndarray, texts: np.ndarray, at: slice | np.ndarray, of_others: bool, states: list[np.ndarray], every: np.ndarray | None = None):
        self.kind, self.depth, self.texts, self.at = kind, depth, texts, at
        self.bit = (code >> U(63 - depth) & U(1)).astype(bool)
        self.place = (code >> U(64 - depth)).astype(np.int64) if 0 < depth < PREFIX else 0
        self.odds = np.empty((INPUTS[kind], len(code)), np.float32)
        if every is not None:
            np.take(_FINE, every.view(np.uint8), out=self.odds[0], mode="clip")
        for k, x in enumerate(states, INPUTS[kind] - len(states)):
            np.take(ODDS_OF_OTHERS if of_others else ODDS, x, out=self.odds[k], mode="clip")
        gates = GATE_OF_OTHERS if of_others else GATE
        self.gate = (gates[0].take(states[-2], mode="clip") + gates[1].take(states[-1], mode="clip")).astype(np.int64)

    @property
    def text(self) -> np.ndarray:
        return self.texts[self.at]


class Model:
    """The weights that mix contexts' log odds, for each depth and gate, and the table that refines the result."""

    def __init__(self):
        self.weights = {k: np.full((CODE_BITS, n, GATES), 1 / n, np.float32) for k, n in INPUTS.items()}
        self.weights["word"][:, :, 0] = [1, 0, 0]
        self.trained = {k: np.zeros((CODE_BITS, GATES)) for k in INPUTS}
        # ones and all, for each depth and place
        self.near = {k: [np.zeros((2, (1 << d if d < PREFIX else 1) * CELLS)) for d in range(CODE_BITS)] for k in INPUTS}

    def mixed(self, bits: Bits) -> np.ndarray:
        """Log odds of each bit's value."""
        weights = self.weights[bits.kind][bits.depth]
        z = bits.odds[0] * weights[0].take(bits.gate, mode="clip")
        for odds, w in zip(bits.odds[1:], weights[1:], strict=True):
            z += odds * w.take(bits.gate, mode="clip")
        return np.clip(z, -11.9, 11.9, out=z)

    @staticmethod
    def cell(bits: Bits, z: np.ndarray) -> np.ndarray:
        return bits.place * CELLS + (np.where(bits.bit, z, -z) + 12).astype(np.int64)

    def train(self, bits: Bits) -> None:
        """Predicts the bits, and learns the weights from the error: steps are as long as the odds' size allows."""
        z = self.mixed(bits)
        cell = self.cell(bits, z)
        near = self.near[bits.kind][bits.depth]
        seen = np.bincount(2 * cell + bits.bit, minlength=2 * near.shape[1])
        near[0] += seen[1::2]
        near[1] += seen[::2] + seen[1::2]
        error = 1 / (1 + np.exp(z))
        square = bits.odds[0] * bits.odds[0]
        for odds in bits.odds[1:]:
            square += odds * odds
        size = np.bincount(bits.gate, error * (1 - error) * square, GATES) + 4
        w = self.weights[bits.kind][bits.depth]
        for k, odds in enumerate(bits.odds):
            w[k] += np.bincount(bits.gate, error * odds, GATES) / size
        self.trained[bits.kind][bits.depth] += np.bincount(bits.gate, minlength=GATES)

    def log10(self, bits: Bits) -> np.ndarray:
        z = self.mixed(bits)
        cell = self.cell(bits, z)
        p = 1 / (1 + np.exp(-z))
        ones, every = (x.take(cell, mode="clip") for x in self.near[bits.kind][bits.depth])
        hits = np.where(bits.bit, ones, every - ones)
        return np.log10(np.clip((p + (hits + 4 * p) / (every + 4)) / 2, 1e-6, 1 - 1e-6))

    def learnt(self) -> dict:
        return {k: [self.weights[k] * self.trained[k][:, None], self.trained[k], *self.near[k]] for k in INPUTS}

    def use(self, learnt: dict) -> None:
        """Takes the means of what blocks have learnt; where no bit was seen, things stay as they are."""
        for k, (weighted, trained, *near) in learnt.items():
            self.weights[k] = np.where(trained[:, None] > 0, weighted / np.maximum(trained[:, None], 1), self.weights[k]).astype(np.float32)
            self.near[k] = near


def _pairs(sent, bits: int):
    def ask(block: B.Block, replies: list[bytes], n: int):
        yield from Sequence(block, replies, sent.value).ask(n, bits)

    return ask


def _count(got: list):
    """What a bucket's contexts have seen, for each pair that was asked about."""
    asked = [load(x[3]) for x in got]
    got = [(x[0], x[1], a[0]) for x, a in zip(got, asked, strict=True)]
    new = [np.unpackbits(np.frombuffer(x[1], np.uint8), count=len(x[3]) // 5) for x in asked]
    edges = np.cumsum([0, *map(len, new)])
    contexts = np.concatenate([np.cumsum(_joined(x[2], 8, np.uint64)) for x in asked])
    codes = np.concatenate([_joined(x[3], 5, np.uint64) for x in asked])
    own = np.concatenate([_joined(x[4], 4, np.uint32) for x in asked])
    del asked
    _, number = distinct(contexts)
    del contexts
    number = number.astype(np.uint32)[np.cumsum(np.concatenate(new)) - 1]
    first, which = distinct(joined(number.astype(U), codes, 1 << CODE_BITS))
    number, codes = number[first], codes[first] << U(64 - CODE_BITS)
    which = which.astype(np.int32)
    counts = np.bincount(which, own).astype(np.int64)
    del new, own
    last = (level(counts) << 4)[which]
    depths, states = np.zeros(len(first), np.uint8), []
    seen, there = np.zeros(len(first), np.uint8), np.zeros(len(first), bool)
    del first
    rest = np.arange(len(which), dtype=np.int32)
    for depth, rows, low, high in walk(number, codes, counts):
        depths[rows] += 1
        seen[rows] = state(high, low - high)
        there[:] = False
        there[rows] = True
        rest = rest[there[which[rest]]]
        states.append((np.searchsorted(rest, edges), seen[which[rest]]))
    depths = depths[which]
    for i, (bucket, block, n) in enumerate(got):
        a, b = edges[i], edges[i + 1]
        yield bucket, block, 0, dump("contexts", n, bucket, last[a:b].tobytes(), depths[a:b].tobytes(), [x[c[i] : c[i + 1]].tobytes() for c, x in states if c[i] < c[i + 1]])


def _learn(sent):
    """What is learnt from each block."""

    def learn(block: B.Block, replies: list[bytes], n: int):
        s = Sequence(block, replies, sent.value)
        s.told(replies)
        model = Model()
        for bits in chain(s.symbol_bits(True), s.byte_bits(True)):
            model.train(bits)
        yield block.block % n, 0, dump(model.learnt())

    return learn


def _add(got: list):
    whole: dict = {}
    for *_, blob in got:
        for k, v in load(blob)[0].items():
            whole[k] = [x + y for x, y in zip(whole[k], v, strict=True)] if k in whole else v
    yield got[0][0], 0, 0, dump(whole)


def _scores(sent):
    def score(block: B.Block, replies: list[bytes]):
        heads, model, texts, v, n = sent.value
        s = Sequence(block, replies, heads)
        s.told(replies)
        t, m = s.t, len(block.ids)
        of_symbol, of_byte = np.zeros(len(s.symbol)), np.zeros(len(s.some_bytes))
        for bits in s.symbol_bits(False):
            of_symbol[bits.at] += np.rint(model.log10(bits) * UNIT)
        for bits in s.byte_bits(False):
            of_byte[bits.at] += np.rint(model.log10(bits) * UNIT)
        total = np.bincount(s.text, of_symbol, m) + np.bincount(s.byte_text, of_byte[s.of_some], m)
        c = t.counts
        size = np.bincount(t.text, minlength=m)
        whole = np.log10(n + v + 1)
        base = np.bincount(t.text, (np.log10(c + 1) - whole)[t.which], m) + np.log10(texts + 1) - whole
        found = np.bincount(t.text, (c > 0)[t.which], m).astype(np.int64) + (texts > 0)
        yield [[block.id(i) for i in range(m)], t.held.tolist(), (size + 1).tolist(), found.tolist(), [n] * m, base.tolist(), (total / UNIT).tolist(), block.sizes.tolist()]

    return score


def _part(col: str, n: int):
    return F.pmod(F.shiftright(F.col(col).cast("long"), 32 if col == "block" else 0), F.lit(n)).cast("int").alias("part")


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes), one row for each row of `docs`.

    Scores are log10 probabilities. A null text is an empty one and has one token, the end; a null doc_id is not held
    out. Without training texts, words are spelled with even odds. Equal texts have equal scores. Other columns are left
    out. Scores don't depend on partitions or on the order of rows. They are computed at once, and written."""
    with short_shuffles(docs.sparkSession):
        return _score_texts(docs)


def _score_texts(docs: DataFrame) -> DataFrame:
    """Blocks ask, learn and score by parts, so that what is shuffled at a time is a small share of what is kept; what
    isn't needed any more is deleted."""
    spark = docs.sparkSession
    broadcast, folder = spark.sparkContext.broadcast, new_path(spark)
    blocks = B.scatter(docs, size=BLOCK_BYTES, path=f"{folder}/blocks")
    n_blocks = blocks.count()
    n, parts = B.buckets(spark, n_blocks), min(max(n_blocks // 4, 1), PARTS)
    words = written(B.answer(B.ask(blocks, _words, n), _sum), "none", f"{folder}/words")
    stats = [load(bytes(r["blob"])) for r in words.filter("kind = 2").select("blob").collect()]  # of all buckets, a row for each group
    texts, v, tokens, single = (int(sum(x[k] for x in stats)) for k in range(4))
    mass = np.zeros(CLASSES * SUBS, np.int64)
    for x in stats:
        np.add.at(mass, x[4], x[5])
    tokens, v = tokens + texts, v + (texts > 0)
    head = broadcast(Heads(mass, single, texts))
    words = words.filter("kind = 0")
    some = lambda df, k: df.filter(_part("block", parts) == k)
    question = _pairs(head, min(64, 40 + n_blocks.bit_length()))
    asked = []
    for k in range(parts):
        ask = B.ask(B.told(some(blocks, k), some(words, k)), question, n)
        asked.append(written(ask.select("*", _part("bucket", parts)), "none", f"{folder}/asked-{k}", "part"))
    contexts = []
    for k in range(parts):
        got = B.answer(reduce(DataFrame.unionByName, asked).filter(F.col("part") == k).drop("part"), _count)
        contexts.append(written(got.select("*", _part("block", parts)), "none", f"{folder}/contexts-{k}", "part"))
        for i in range(parts):
            remove(spark, f"{folder}/asked-{i}/part={k}")
    replies = lambda k: reduce(DataFrame.unionByName, contexts).filter(F.col("part") == k).drop("part").unionByName(some(words, k))
    told = [B.told(some(blocks, k), replies(k)) for k in range(parts)]
    model = Model()
    whole: dict = {}
    for x in told:
        for r in sorted(B.answer(B.ask(x, _learn(head), 16), _add).collect(), key=lambda x: x["bucket"]):  # 16 rows of fixed size
            for k, x in load(bytes(r["blob"]))[0].items():
                whole[k] = [a + b for a, b in zip(whole[k], x, strict=True)] if k in whole else x
    model.use(whole)
    score = _scores(broadcast((head.value, model, texts, v, tokens)))
    scored = [written(B.each(x, score, _SCHEMA, _OUT)) for x in told]
    remove(spark, folder)
    return reduce(DataFrame.unionByName, scored)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).drop("n_bytes")
