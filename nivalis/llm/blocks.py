"""Blocks of texts, and questions that blocks ask about the whole corpus.

Several operators need, for parts of a text, to know where else in the corpus they are. A block is a row that holds some
megabytes of texts, compressed. A block's task sends what it asks to buckets (by a hash of the thing asked about), once
for each distinct thing; a bucket's task sees all blocks' questions about the same things and sends replies by block;
replies are joined to the blocks. So nothing is proportional to the square of anything, and a thing that a third of all
texts hold is asked about once a block.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm.tables import partitions, small_batches, written

BLOCK_BYTES = 2 << 20
NO_ID = (1 << 63) - 1  # a null id, which counts as the largest
ASK = "bucket int, block long, kind int, blob binary"
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])

# ---- hashing -------------------------------------------------------------------------------------------------------

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix64(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    x = np.bitwise_xor(x, x >> U(33), out=out)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= U(factor)
        x ^= x >> U(33)
    return x


BYTES = mix64(np.arange(1, 257, dtype=U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverses modulo 2^64, for i < n at least."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(m, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Prefix:
    """Prefix polynomial hashes of a sequence of 64-bit values: the hash of any span in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, n: int) -> np.ndarray:
        """The hashes of all spans of n values, of which there is one at least."""
        out = self.sums[n:] - self.sums[:-n]
        out *= self.down[: len(out)]
        return out


def smallest(values: np.ndarray, w: int) -> np.ndarray:
    """Of each w consecutive values, where the smallest is; the rightmost of equal ones."""
    at, width = np.arange(len(values), dtype=np.int32), 1
    while width < w:
        step = min(width, w - width)
        right = values[step:] <= values[:-step]
        at = np.where(right, at[step:], at[:-step])
        values = np.where(right, values[step:], values[:-step])
        width += step
    return at


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


class Block:
    """`data`: the texts, each followed by a line feed; text i is data[starts[i] : starts[i] + sizes[i]]."""

    def __init__(self, block: int, ids: np.ndarray, sizes: np.ndarray, data: bytes):
        self.block, self.ids, self.sizes, self.data = block, ids, sizes, data
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.bytes = np.frombuffer(data, np.uint8)

    def id(self, i: int) -> int | None:
        return None if self.ids[i] == NO_ID else int(self.ids[i])

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the text it is in."""
        a, b = runs(~space[self.bytes])
        return a, b, np.repeat(np.arange(len(self.starts)), np.diff(np.searchsorted(a, self.starts), append=len(a)))


# ---- rows ----------------------------------------------------------------------------------------------------------


_small, _wide = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def squeezed(data: bytes) -> bytes:
    return _small.compress(data)


def unsqueezed(blob: bytes) -> bytes:
    return _wide.decompress(blob)


def dump(*values) -> bytes:
    return squeezed(pickle.dumps(values, 5))


def load(blob: bytes) -> tuple:
    return pickle.loads(unsqueezed(blob))


def rows(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows; where these have a third column, of rows with the same value of it, which numbers the block."""
    from pyspark import TaskContext

    part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def flush():
        nonlocal n, ids, texts, size
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = zstandard.ZstdCompressor(3).compress(b"\n".join([*texts, b""]))
        out = rows(_BLOCK, [[part << 32 | n], [np.array(ids, np.int64).tobytes()], [sizes.tobytes()], [data]])
        n, ids, texts, size = n + 1, [], [], 0
        return out

    for batch in batches:
        fixed = batch.column(2).to_pylist() if batch.num_columns > 2 else [part] * batch.num_rows
        for i, text, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), fixed, strict=True):
            if p != part:
                if ids:
                    yield flush()
                part, n = p, 0
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= most:
                yield flush()
    if ids:
        yield flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of at least `size` bytes of texts, written to the shared folder. A null text is an empty one."""
    small_batches(docs.sparkSession)
    body = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return written(body.mapInArrow(lambda x: _pack(x, size), "block long, ids binary, sizes binary, data binary"), "none")


def scatter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, path: str | None = None) -> DataFrame:
    """As `pack`, but which texts are together, and in what order, depends on the rows alone and not on how they are dealt: by a hash
    of id and text, for as many blocks as all bytes need. Equal rows may fill more than one."""
    spark = docs.sparkSession
    small_batches(spark)
    body = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    total = body.agg(F.sum(F.octet_length("t") + F.lit(1).cast("long"))).first()[0] or 0
    n = max(1, -(-total // size))
    order = body.withColumn("h", F.xxhash64("i", "t")).withColumn("n", F.pmod(F.col("h"), F.lit(n).cast("long")))
    order = order.repartition(max(partitions(spark), n // 4), "n").sortWithinPartitions("n", "h", "i", "t")
    return written(order.select("i", "t", "n").mapInArrow(lambda x: _pack(x, 2 * size), "block long, ids binary, sizes binary, data binary"), "none", path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[bytes]]]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            x = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
            data = zstandard.ZstdDecompressor().decompress(x["data"])
            yield Block(x["block"], np.frombuffer(x["ids"], np.int64), np.frombuffer(x["sizes"], np.int64), data), x.get("replies") or []


def buckets(spark: SparkSession, n_blocks: int, blocks: int = 4) -> int:
    """As many buckets, one for so many `blocks`, that what blocks ask one about fits a task, however many partitions there are."""
    return max(partitions(spark), n_blocks // blocks)


def ask(blocks: DataFrame, question: Callable, n: int) -> DataFrame:
    """`question(block, replies, n)` yields (bucket, kind, blob), for buckets 0 to n - 1."""

    def run(batches):
        for block, replies in _blocks(batches):
            out = list(question(block, replies, n))
            if out:
                yield rows(_ASK, [[x[0] for x in out], [block.block] * len(out), [x[1] for x in out], [x[2] for x in out]])

    return blocks.mapInArrow(run, ASK)


def answer(asked: DataFrame, reply: Callable) -> DataFrame:
    """`reply(rows)` gets all (bucket, block, kind, blob) of one bucket, and yields (bucket, block, kind, blob).

    A task holds one bucket at a time: rows come in order of buckets, sorted by Spark. Buckets are dealt to tasks in turn."""

    def run(batches):
        rows_of = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "kind", "blob")), strict=True))
        for _, got in itertools.groupby(rows_of, key=lambda x: x[0]):
            out = list(reply(list(got)))
            for i in range(0, len(out), 1000):
                yield rows(_ASK, [list(c) for c in zip(*out[i : i + 1000], strict=True)])

    return asked.repartitionById(partitions(asked.sparkSession), "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, ASK)


def told(blocks: DataFrame, replies: DataFrame, how: str = "left") -> DataFrame:
    """Blocks with the blobs that were sent to them, in no order, as `replies`."""
    by = replies.groupBy("block").agg(F.collect_list("blob").alias("replies"))
    return blocks.join(by, "block", how)


def each(blocks: DataFrame, fn: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """`fn(block, replies)` yields lists of columns."""

    def run(batches):
        for block, replies in _blocks(batches):
            for columns in fn(block, replies):
                yield rows(arrow, columns)

    return blocks.mapInArrow(run, schema)


def split(n_buckets: int, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, where its keys are), by the keys' upper bits."""
    bucket = ((keys >> U(33)) % U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for at in np.split(order, edges[1:]) if len(order) else []:
        yield int(bucket[at[0]]), at
