"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), in time linear in the features.
It is fitted on at most `TRAIN_ROWS` labelled rows, those whose id hashes are smallest; every row is scored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import blocks as B
from nivalis.llm.blocks import U
from nivalis.llm.neardup import batches_of
from nivalis.llm.tables import read, small_batches

TRAIN_ROWS = 20_000
BUCKETS, BINS, FACTORS = 1 << 14, 16, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 256, 0.1, 1e-6, 3
THRESHOLD = 0.3
STATS = ("upper", "digit", "mark", "bar", "wide", "space", "line_ends", "word_length", "distinct", "repeated_lines", "bytes", "end_marks", "marked_words")
N_FEATURES = BUCKETS + len(STATS) * BINS

_KINDS = np.zeros(256, np.int64)  # 0 other letters, 1 upper case, 2 digit, 3 mark, 4 bar, 5 not ASCII, 6 space, 7 line feed
_KINDS[0x41:0x5B], _KINDS[0x30:0x3A], _KINDS[0x80:] = 1, 2, 5
_KINDS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = 3
_KINDS[0x7C], _KINDS[[0x20, 9, 11, 12, 13]], _KINDS[0x0A] = 4, 6, 7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FEATURES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted by text: the share of each hashed word, and which bin each statistic is in."""
    m = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, m)
    block = B.Block(0, sizes, sizes, b"\n".join([*texts, b""]))
    start, end, text = block.words()
    words = B.mix64(B.Prefix(B.BYTES[_LOWER[block.bytes]]).spans(start, end))
    n = np.bincount(text, minlength=m)
    key, count = np.unique(text.astype(np.int64) * BUCKETS + (words % U(BUCKETS)).astype(np.int64), return_counts=True)
    of, at = key // BUCKETS, key % BUCKETS
    value = 2.0 * count / n[of]
    share = np.zeros((m, len(STATS)))
    owner = np.repeat(np.arange(m), sizes + 1)
    kinds = np.bincount(owner * 8 + _KINDS[block.bytes], minlength=m * 8).reshape(m, 8)
    kinds[:, 7] -= 1
    size = np.maximum(sizes, 1)
    share[:, 0:6] = np.stack([kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 4] * 4, kinds[:, 5], kinds[:, 6]], 1) / size[:, None]
    share[:, 6] = kinds[:, 7] * 10 / size
    some = np.maximum(n, 1)
    share[:, 7] = np.bincount(text, end - start, m) / some / 24
    share[:, 8] = np.bincount(of, minlength=m) / some
    # lines: how many are repeats, and how many end with a mark
    is_end = np.flatnonzero(block.bytes == 0x0A)
    first = np.concatenate(([0], is_end[:-1] + 1))
    full = is_end > first
    a, b = first[full], is_end[full]
    line_of = owner[a]
    line = B.mix64(B.Prefix(B.BYTES[block.bytes]).spans(a, b)) ^ B.mix64(line_of.astype(U))
    lines = np.maximum(np.bincount(line_of, minlength=m), 1)
    distinct = np.bincount(line_of[np.unique(line, return_index=True)[1]], minlength=m)
    share[:, 9] = 1 - np.where(distinct > 0, distinct, lines) / lines
    share[:, 10] = np.log2(sizes + 1) / 20
    share[:, 11] = np.bincount(line_of, np.isin(block.bytes[b - 1], [0x2E, 0x21, 0x3F]), m) / lines
    if len(start):
        marked = _KINDS[block.bytes[end - 1]] == 3
        share[:, 12] = np.bincount(text, marked, m) / some
    cell = np.minimum((np.sqrt(np.clip(share, 0, 1)) * BINS).astype(np.int64), BINS - 1)
    stat_at = BUCKETS + np.arange(len(STATS)) * BINS + cell
    of = np.concatenate([of, np.repeat(np.arange(m), len(STATS))])
    at = np.concatenate([at, stat_at.ravel()])
    value = np.concatenate([value, np.full(m * len(STATS), 0.5)])
    order = np.argsort(of, kind="stable")
    return of[order], at[order], value[order]


class Machine:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS))

    def parts(self, of: np.ndarray, at: np.ndarray, x: np.ndarray, m: int):
        vx = self.v[at] * x[:, None]
        edge = np.searchsorted(of, np.arange(m))  # every text has its statistics
        total = np.add.reduceat(vx, edge, axis=0)
        squares = np.add.reduceat(vx * vx, edge, axis=0)
        return self.w0 + np.bincount(of, self.w[at] * x, m) + 0.5 * (total * total - squares).sum(1), total, vx

    def score(self, of, at, x, m) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(of, at, x, m)[0], -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> "Machine":
        rng, gw, gv, g0 = np.random.default_rng(SEED), np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                of = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
                at, x = np.concatenate([docs[i][0] for i in some]), np.concatenate([docs[i][1] for i in some])
                z, total, vx = self.parts(of, at, x, len(some))
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]
                used, where = np.unique(at, return_inverse=True)
                ex = error[of] * x
                step_w = np.bincount(where, ex) + DECAY * self.w[used]
                step_v = np.stack([np.bincount(where, ex * (total[of, f] - vx[:, f])) for f in range(FACTORS)], 1) + DECAY * self.v[used]
                gw[used] += step_w**2
                gv[used] += step_v**2
                g0 += error.sum() ** 2
                self.w[used] -= RATE * step_w / np.sqrt(gw[used])
                self.v[used] -= RATE * 0.5 * step_v / np.sqrt(gv[used])
                self.w0 -= RATE * error.sum() / np.sqrt(g0)
        return self


def _features(batches):
    for batch in batches:
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, texts in batches_of(batch, 2):
            of, at, x = features(texts)
            edge = np.searchsorted(of, np.arange(len(texts) + 1))
            pieces = list(zip(edge[:-1], edge[1:], strict=True))
            yield B.rows(_FEATURES, [ids[a:b], labels[a:b], [at[u:v].astype(np.int32).tobytes() for u, v in pieces], [x[u:v].astype(np.float32).tobytes() for u, v in pieces]])


def held_out(id_col: str, n: int, rest: int):
    """crc32 of the id as text, modulo n, is `rest`; a null id counts as no text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n)) == rest


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Fitted on at most `train_rows` of the labelled rows that aren't held out; without any, every score is 0.5."""
    small_batches(docs.sparkSession)
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).filter(~held_out("doc_id", 5, 0))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(train_rows).withColumnRenamed("doc_id", "l_id")
    # at most train_rows pairs of numbers
    rows = docs.join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    got = rows.mapInArrow(_features, "doc_id long, label int, at binary, x binary").toArrow().sort_by("doc_id")
    machine = Machine()
    if got.num_rows:
        pairs = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float)) for a, x in zip(got["at"].to_pylist(), got["x"].to_pylist(), strict=True)]
        machine.fit(pairs, got["label"].to_numpy().astype(float))
    return machine


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", score: str = "score") -> DataFrame:
    """`docs` with the column `score`, the probability of label 1. A null text is an empty one; it is scored like any other."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch))
            for a, b, texts in batches_of(pa.RecordBatch.from_arrays([pa.array(batch, pa.binary())], ["text"]), 0):
                out[a:b] = sent.value.score(*features(texts), len(texts))
            yield pd.Series(out)

    return docs.withColumn(score, probability(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
