"""Substring dedup with repeated-phrase automata.

First, recurring phrases are confirmed: windows of WINDOW words whose anchor recurs are compared by their exact words, and
each block is told which of its windows several documents have, and the smallest of these. Then a block compiles what it
was told to Aho-Corasick automata over the digits of words' numbers, a shard of at most SHARD windows at a time, and streams all its
documents whole through each: every removed word is in a match of an automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nivalis.llm import blocks as B
from nivalis.llm.repeats import Contexts, among, together, with_anchors
from nivalis.llm.tables import read

WINDOW, GRAM = 13, 6
SHARD = 20_000  # windows of an automaton, which has some 25 MB then
BASE = 128  # of words' numbers
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def word_hashes(block: B.Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return B.mix64(B.Prefix(B.BYTES[block.bytes]).spans(start, end))


def contexts(block: B.Block) -> Contexts:
    start, end, text = block.words()
    c = Contexts(word_hashes(block, start, end), text, WINDOW, GRAM)
    c.phrase = lambda a, b: b" ".join(block.data[start[a] : end[b - 1]].split())
    return c


def _send(block: B.Block, replies: list[bytes], n: int) -> Iterator[tuple]:
    """Contexts whose anchor recurs, equal ones once: the smallest document that has it, and whether others of the block have it."""
    c = contexts(block)
    take = among(c, replies)
    take = take[np.argsort(block.ids[c.text[take]], kind="stable")]
    first, doc = c.first[take], block.ids[c.text[take]]
    lead: dict[bytes, int] = {}
    more = np.zeros(len(take), bool)
    for i, (a, b, d) in enumerate(zip(first.tolist(), (c.last[take] + WINDOW).tolist(), doc.tolist(), strict=True)):
        j = lead.setdefault(c.phrase(a, b), i)
        more[j] |= d != doc[j]
    texts, send = list(lead), np.fromiter(lead.values(), np.int64, len(lead))
    for bucket, at in B.split(n, c.key[take][send]):
        i = send[at]
        yield bucket, 0, B.dump(c.key[take][i], doc[i], more[i], first[i].astype(np.int32), [texts[k] for k in at.tolist()])


def recurring(doc: list[int], more: list[bool], texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(context, first and last window, smallest document) of windows that several documents have, where the context's block has them
    in a later one. Equal contexts are read once."""
    number: dict[bytes, int] = {}
    classes: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts):
        classes.setdefault(t, []).append(i)
    least: dict[tuple, int] = {}
    several = set()
    windows = []
    for t, members in classes.items():
        words = tuple([number.setdefault(w, len(number)) for w in t.split()])
        windows.append([words[o : o + WINDOW] for o in range(len(words) - WINDOW + 1)])
        ids = [doc[i] for i in members]
        low, others = min(ids), min(ids) < max(ids) or any(more[i] for i in members)
        for w in windows[-1]:
            x = least.setdefault(w, low)
            if others or x != low:
                several.add(w)
                least[w] = min(x, low)
    for own, members in zip(windows, classes.values(), strict=True):
        runs = [(low, [o for o, _ in run]) for low, run in groupby(enumerate(own), lambda x: least[x[1]] if x[1] in several else None) if low is not None]
        for i in members:
            for low, at in runs:
                if low < doc[i] or more[i]:
                    yield i, at[0], at[-1], low


def _confirm(got: list) -> Iterator[tuple]:
    sent = [(block, *B.load(blob)) for _, block, _, blob in got]
    block = np.repeat([x[0] for x in sent], [len(x[1]) for x in sent])
    key, doc, more, first = (np.concatenate([x[k] for x in sent]) for k in range(1, 5))
    texts = [t for x in sent for t in x[5]]
    out: dict[int, list] = {}
    for at in together(key):
        for i, a, b, low in recurring(doc[at].tolist(), more[at].tolist(), [texts[j] for j in at.tolist()]):
            j = int(at[i])
            out.setdefault(int(block[j]), []).append((int(first[j]) + a, int(first[j]) + b, low))
    for blk, phrases in out.items():
        yield 0, blk, 0, B.dump(np.array(phrases, np.int64).T)


def _coded(words: list[bytes], at: np.ndarray) -> tuple[str, int]:
    """Words as numbers, in as few digits each as tell those of windows, which start at `at`, apart; all others are 0. A node of an
    automaton has at most BASE children, among which it looks one after another."""
    phrase = np.zeros(len(words) + 1, np.int64)
    np.add.at(phrase, at, 1)
    np.subtract.at(phrase, at + WINDOW, 1)
    number: dict[bytes, int] = {}
    for i in np.flatnonzero(np.cumsum(phrase)).tolist():
        number.setdefault(words[i], len(number) + 1)
    codes = np.array([number.get(w, 0) for w in words], np.int32)
    width = 1
    while BASE**width <= len(number):
        width += 1
    digits = np.empty((len(codes), width), np.uint8)
    for k in range(width):
        digits[:, width - 1 - k] = codes // BASE**k % BASE
    return digits.tobytes().decode("latin-1"), width


def covered(block: B.Block, words: list[bytes], edge: np.ndarray, replies: list[bytes]) -> np.ndarray:
    """Which of the block's words are in a window that a document of smaller id has too; text i has words edge[i] to edge[i + 1]."""
    depth = np.zeros(edge[-1] + 1, np.int64)
    if replies:
        first, last, low = np.concatenate([B.load(x)[0] for x in replies], axis=1)
        size = last - first + 1
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        coded, width = _coded(words, at)
        least = dict(zip([coded[a * width : (a + WINDOW) * width] for a in at.tolist()], np.repeat(low, size).tolist(), strict=True))
        texts = [coded[a * width : b * width] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        for shard in batched(least.items(), SHARD):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for window, doc in shard:
                automaton.add_word(window, doc)
            automaton.make_automaton()
            for a, d, text in zip(edge.tolist(), block.ids.tolist(), texts, strict=False):
                found = [end + 1 for end, doc in automaton.iter(text) if doc < d]
                if not found:
                    continue
                ends = np.array(found)
                ends = a + ends[ends % width == 0] // width  # others begin within a word's digits
                depth[ends - WINDOW] += 1
                depth[ends] -= 1
    return np.cumsum(depth)[:-1] > 0


def _kept(block: B.Block, replies: list[bytes]):
    _, _, text = block.words()
    edge = np.searchsorted(text, np.arange(len(block.ids) + 1))
    every = block.data.split()
    gone = covered(block, every, edge, replies)
    removed = np.concatenate(([0], np.cumsum(gone)))
    out = [[], [], [], []]
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        words = every[a:b]
        if n := int(removed[b] - removed[a]):
            words = [w for w, x in zip(words, gone[a:b].tolist(), strict=True) if not x]
        out[0].append(block.id(i))
        out[1].append(b - a)
        out[2].append(n)
        out[3].append(b" ".join(words))
    yield out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text's words but those covered by WINDOW words in a row that a document
    of smaller id also has. Words are runs without white space, compared byte by byte.

    A null text has no words; fewer than WINDOW words are kept; a null doc_id counts as the largest, and rows of equal
    doc_id don't remove each other's words. Other columns are left out; an empty table gives an empty result."""
    blocks = B.pack(docs)
    n = B.buckets(blocks.sparkSession, blocks.count())
    confirmed = B.answer(B.ask(with_anchors(blocks, contexts, n), _send, n), _confirm)
    return B.each(B.told(blocks, confirmed), _kept, "doc_id long, n_words long, n_removed long, kept binary", _OUT)


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
