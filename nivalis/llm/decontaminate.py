"""Benchmark decontamination by winnowing.

Of every WINDOW_GRAMS consecutive hashes of GRAM words the smallest (rightmost of equal ones) is a fingerprint; a
shared span of WINDOW = GRAM + WINDOW_GRAMS - 1 words has a shared fingerprint. Documents' fingerprints are joined with
the benchmark's, and each hit is extended word by word to both sides: with WINDOW words or more in all, they are hit.

The benchmark is dealt to the documents in parts of at most PART_BYTES of text; each part is sent to all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import blocks as B
from nivalis.llm.blocks import U
from nivalis.llm.tables import read, small_batches, unused, written

WINDOW, GRAM = 13, 8
WINDOW_GRAMS = WINDOW - GRAM + 1
PART_BYTES = 8 << 20
PER_BATCH = 2 << 20  # bytes of documents that are looked at together

#: What ends a word, as bytes: all ASCII but digits and letters (A-Z are lower-cased first).
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_OUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
OUT = "row long, doc_id long, n_words long, spans array<long>, items array<string>"


class Words:
    """Lower-cased words of some texts: their hashes, where they are, and the text they are in."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.start, self.end = B.runs(~NOT_WORD[self.data])
        self.text = np.searchsorted(begin, self.start, "right") - 1
        self.hash = B.mix64(B.Prefix(B.BYTES[self.data]).spans(self.start, self.end))
        self.edge = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.prefix = B.Prefix(self.hash)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n words in a row of one text begin, and their hashes."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        hashes = B.mix64(self.prefix.spans(at, at + n))
        whole = self.text[at] == self.text[at + n - 1] if len(at) else np.zeros(0, bool)
        return whole, hashes

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Where kept grams begin, and their hashes."""
        whole, hashes = self.grams(GRAM)
        if len(hashes) < WINDOW_GRAMS:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = B.smallest(hashes, WINDOW_GRAMS)
        inside = self.text[: len(at)] == self.text[WINDOW - 1 : WINDOW - 1 + len(at)]
        at = np.unique(at[inside]).astype(np.int64)
        return at, hashes[at]

    def spelled(self, a: int, b: int) -> list[bytes]:
        return [self.data[x:y].tobytes() for x, y in zip(self.start[a:b], self.end[a:b], strict=True)]


def _sorted(hashes: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    return [hashes[order], *(m[order] for m in more)]


def _matches(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with known[i] == asked[j]; known is sorted."""
    lo, hi = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(asked)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), j


class Benchmark:
    def __init__(self, ids: list[str], texts: list[bytes]):
        self.ids, self.words = ids, Words(texts)
        n = np.diff(self.words.edge)
        at, hashes = self.words.fingerprints()
        self.known, self.at = _sorted(hashes, at)
        self.short = {}  # items of fewer words: one window of all
        for size in sorted({int(x) for x in n if 0 < x < WINDOW}):
            first = self.words.edge[:-1][n == size]
            self.short[size] = _sorted(B.mix64(self.words.prefix.spans(first, first + size)), first)

    def hits(self, docs: Words) -> np.ndarray:
        """Rows (first word, end, item) of documents' words that are hit."""
        out = []
        at, hashes = docs.fingerprints()
        i, j = _matches(self.known, hashes)
        if len(i):
            d, b = at[j], self.at[i]  # first word of the gram in the document and in the item
            left, right = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
            doc_lo, doc_hi = docs.edge[docs.text[d]], docs.edge[docs.text[d] + 1]
            item_lo, item_hi = self.words.edge[self.words.text[b]], self.words.edge[self.words.text[b] + 1]
            for step in range(1, WINDOW - GRAM + 1):
                ok = (left == step - 1) & (d - step >= doc_lo) & (b - step >= item_lo)
                left[ok] += docs.hash[d[ok] - step] == self.words.hash[b[ok] - step]
                e, f = d + GRAM - 1 + step, b + GRAM - 1 + step
                ok = (right == step - 1) & (e < doc_hi) & (f < item_hi)
                right[ok] += docs.hash[e[ok]] == self.words.hash[f[ok]]
            good = left + right + GRAM >= WINDOW
            out.append(np.stack([d - left, d + GRAM + right, b - left], 1)[good])
        for size, (known, first) in self.short.items():
            whole, hashes = docs.grams(size)
            at = np.flatnonzero(whole)
            i, j = _matches(known, hashes[at])
            out.append(np.stack([at[j], at[j] + size, first[i]], 1))
        hits = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        keep = [docs.spelled(a, b) == self.words.spelled(c, c + b - a) for a, b, c in hits.tolist()]
        hits = hits[np.array(keep, bool)]
        hits[:, 2] = self.words.text[hits[:, 2]]
        return hits


def _scan(benchmark, batches):
    item = benchmark.value
    for batch in batches:
        rows, ids, texts = (batch.column(k).to_pylist() for k in range(3))
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= PER_BATCH):
                size += len(texts[b])
                b += 1
            words = Words(texts[a:b])
            spans = [[] for _ in range(a, b)]
            items = [set() for _ in range(a, b)]
            for x, y, i in item.hits(words).tolist():
                t = int(words.text[x])
                first = int(words.edge[t])
                spans[t] += [x - first, y - first]
                items[t].add(item.ids[i])
            yield B.rows(_OUT, [rows[a:b], ids[a:b], np.diff(words.edge).tolist(), spans, [sorted(x) for x in items]])
            a = b


def contaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, spans, items): `spans` are first and end word of what is hit, in pairs; `items` the ids,
    as strings, of the items found. `row` is the column `row_col` of `docs`, a number of its own for each row; if none is
    named, one is given where several parts need it, and else it is null. Other columns are left out.

    Null texts have no words; items without words are never found; a null item id is left out; repeated rows and items
    are judged each for itself; an empty table gives an empty result, an empty benchmark no hits."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text")).filter("id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    if n > 1 and row_col is None:
        (row_col,) = unused(docs, "row")
        docs = written(docs.withColumn(row_col, F.monotonically_increasing_id()))
    row = F.lit(None).cast("long") if row_col is None else F.col(row_col).cast("long")
    body = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    out = None
    for k in range(n):  # parts of the benchmark, each of bounded size; one, for a benchmark of some MB
        got = sorted((r["id"], bytes(r["text"])) for r in items.filter(part == k).collect())
        sent = spark.sparkContext.broadcast(Benchmark([i for i, _ in got], [t for _, t in got]))
        found = body.mapInArrow(lambda batches, sent=sent: _scan(sent, batches), OUT)
        # of the later parts only rows that are hit are added
        out = found if out is None else out.unionAll(found.filter("size(items) > 0"))
    if n > 1:
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return out


def _digest(batches):
    for batch in batches:
        out = [[], [], [], [], [], [], []]
        for row, i, n, spans, items in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            n_hit, last = 0, 0
            for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                n_hit += max(0, b - max(a, last))
                last = max(last, b)
            items = sorted(set(items))
            for column, x in zip(out, (row, i, n, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n), strict=True):
                column.append(x)
        yield B.rows(_JUDGED, out)


_JUDGED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def judged(docs: DataFrame, benchmark: DataFrame, row_col: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated): as `contaminate`, with the hit words counted.
    A document is contaminated if a word is hit and at least one word in twenty."""
    return contaminate(docs, benchmark, row_col=row_col).mapInArrow(_digest, "row long, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs`, with all their columns, without contaminated rows. Rows of null text are kept; rows of equal id and text are judged
    alike."""
    (name,) = unused(docs, "row")
    rows = docs.withColumn(name, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    bad = judged(rows.select(name, "doc_id", "text"), benchmark, name).filter("contaminated").select(F.col("row").alias(name)).distinct()
    return rows.join(written(bad), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")).drop("row")
