"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles (5 words). Equal texts are one node. Candidates are texts that agree in a band of MinHash
values; a pair's values are then compared 32 at a time, and the pair is dropped when the posterior probability that its
similarity reaches THRESHOLD (uniform prior) falls below TOLERANCE. What is left is verified on the exact sets.

Candidates are gathered by component of the candidate graph. A large component is cut into tiles, every two of which
meet in a task of their own; tasks give counts of links and spanning edges, so no list of all pairs is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import blocks as B
from nivalis.llm.blocks import U
from nivalis.llm.components import components
from nivalis.llm.tables import partitions, read, small_batches, unused, written

WORDS, THRESHOLD = 5, (4, 5)  # similarity is at least 4 / 5
BANDS, ROWS, STEP = 32, 5, 32
HASHES = BANDS * ROWS
TOLERANCE = 1e-7
TILE_TEXTS, TILE_SHINGLES = 512, 1 << 20
PER_BATCH = 2 << 20
MULTIPLY = (B.mix64(np.arange(1, HASHES + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
ADD = (B.mix64(np.arange(1001, HASHES + 1001, dtype=U)) >> U(32)).astype(np.uint32)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SET = pa.schema([("node", pa.int64()), ("comp", pa.int64()), ("tiles", pa.int32()), ("sig", pa.binary()), ("shingles", pa.binary())])
_LINK = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def fewest(n: int, tolerance: float = TOLERANCE) -> int:
    """Matches among n MinHash values below which P(similarity >= THRESHOLD) is under `tolerance`."""
    s = np.linspace(0, 1, 200_001)[1:-1]
    for m in range(n + 1):
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        density = np.exp(log - log.max())
        if density[s >= THRESHOLD[0] / THRESHOLD[1]].sum() / density.sum() >= tolerance:
            return m
    return n


def batches_of(batch: pa.RecordBatch, text_column: int):
    """(from, to, texts) of at most PER_BATCH bytes, or one text."""
    texts, a = batch.column(text_column).to_pylist(), 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= PER_BATCH):
            size += len(texts[b])
            b += 1
        yield a, b, texts[a:b]
        a = b


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the text each is of, in order. Fewer than WORDS words, but not none, are one shingle."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    block = B.Block(0, sizes, sizes, b"\n".join([*texts, b""]))
    start, end, text = block.words()
    words = B.mix64(B.Prefix(B.BYTES[block.bytes]).spans(start, end))
    prefix = B.Prefix(words)
    edge = np.searchsorted(text, np.arange(len(texts) + 1))
    n = np.diff(edge)
    at = np.arange(max(0, len(words) - WORDS + 1))
    at = at[text[at] == text[at + WORDS - 1]] if len(at) else at
    short = np.flatnonzero((n > 0) & (n < WORDS))
    a, b = np.concatenate([at, edge[short]]), np.concatenate([at + WORDS, edge[short + 1]])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return B.mix64(prefix.spans(a, b) + (b - a).astype(U)), text[a]


def _sketch(batches):
    for batch in batches:
        ids, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, texts in batches_of(batch, 2):
            hashes, text = shingles(texts)
            n = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
            has = np.flatnonzero(n)
            sig = np.full((len(texts), HASHES), 0xFFFFFFFF, np.uint32)
            if len(has):
                low = (hashes >> U(32)).astype(np.uint32)
                first = np.searchsorted(text, has)
                for k in range(HASHES):
                    sig[has, k] = np.minimum.reduceat(low * MULTIPLY[k] + ADD[k], first)
            bands = np.zeros((len(texts), BANDS), U)
            for r in range(ROWS):
                bands = B.mix64(bands + sig[:, r::ROWS].astype(U) + U(1))
            bands = B.mix64(bands + np.arange(1, BANDS + 1, dtype=U)).view(np.int64)
            own = [x.tolist() if k else [] for x, k in zip(bands, n.tolist(), strict=True)]
            yield B.rows(_SKETCH, [ids[a:b], nodes[a:b], n.tolist(), [x.tobytes() for x in sig], own])


def _sets(batches):
    for batch in batches:
        rest = [batch.column(k).to_pylist() for k in range(4)]
        for a, b, texts in batches_of(batch, 4):
            hashes, text = shingles(texts)
            edge = np.searchsorted(text, np.arange(len(texts) + 1))
            yield B.rows(_SET, [*(c[a:b] for c in rest), [np.unique(hashes[x:y]).tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]])


def _linked(node: list[int], tile: np.ndarray, sig: np.ndarray, sets: list[bytes], both: bool, least: list[int]):
    """(node, root, links) of one pair of tiles, or of one tile with itself."""
    m = len(node)
    sizes = np.array([len(x) // 8 for x in sets])
    left = np.arange(m) if not both else np.flatnonzero(tile == tile.min())
    parent, links = list(range(m)), [0] * m
    made: dict[int, set] = {}

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def of(i: int) -> set:
        if i not in made:
            made[i] = set(np.frombuffer(sets[i], U).tolist())
        return made[i]

    num, den = THRESHOLD
    other = np.flatnonzero(tile != tile.min()) if both else None
    for i in left.tolist():
        j = other if both else np.arange(i + 1, m)
        j = j[(num * np.maximum(sizes[j], sizes[i]) <= den * np.minimum(sizes[j], sizes[i]))]
        same = np.zeros(len(j), np.int64)
        for k, low in enumerate(least):  # STEP more values are compared, and hopeless pairs go
            same = same + (sig[j, k * STEP : (k + 1) * STEP] == sig[i, k * STEP : (k + 1) * STEP]).sum(1)
            j, same = j[same >= low], same[same >= low]
        for x in j.tolist():
            shared = len(of(i) & of(x))
            if den * shared >= num * (sizes[i] + sizes[x] - shared):
                links[i] += 1
                links[x] += 1
                parent[max(top(i), top(x))] = min(top(i), top(x))
    return [(node[i], node[top(i)], links[i]) for i in range(m) if links[i]]


def _compare(batches):
    least = [fewest(STEP * (k + 1)) for k in range(HASHES // STEP)]
    key, group, out = None, [], []

    def flush():
        if len(group) > 1:
            both = key[1] != key[2]
            sig = np.stack([np.frombuffer(x[2], np.uint32) for x in group])
            out.extend(_linked([x[0] for x in group], np.array([x[1] for x in group]), sig, [x[3] for x in group], both, least))

    for batch in batches:
        for comp, a, b, node, tile, sig, sets in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if (comp, a, b) != key:
                flush()
                key, group = (comp, a, b), []
            group.append((node, tile, sig, sets))
        if len(out) > 5000:
            yield B.rows(_LINK, [list(c) for c in zip(*out, strict=True)])
            out = []
    flush()
    if out:
        yield B.rows(_LINK, [list(c) for c in zip(*out, strict=True)])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, class_id, n_links, n_equal), one row for each row of `docs`.

    node: the text's hash, equal for equal texts. class_id: the smallest doc_id of all texts that are tied to this one
    by links (similarity of at least THRESHOLD), itself among them. n_links: different texts that this one is linked to.
    n_equal: rows of this text. A null text is an empty one; empty texts are linked to none but equal; texts of fewer
    than five words have one shingle; rows of null doc_id get a class, which is null only if all its ids are."""
    spark = docs.sparkSession
    n = partitions(spark)
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))
    sketches = written(body.mapInArrow(_sketch, "doc_id long, node long, n long, sig binary, bands array<long>"))
    # one row of each text: copies are put together, partly before the shuffle, so that no band and no join sees them
    nodes = written(sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_equal"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("u"), F.max("node").alias("w")).filter("u <> w").drop("w")
    near = bands.join(shared, "band").select("u", F.col("node").alias("v")).filter("u <> v").distinct()
    comps = components(near)
    # each text with its component and the number of tiles that its component is cut into
    one = written(nodes.select("node", "least", "n", "sig").join(comps.withColumnRenamed("root", "comp"), "node"))
    size = one.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    texts = body.withColumnRenamed("node", "t_node").withColumnRenamed("doc_id", "t_id")
    found = one.join(size, "comp").join(texts, (F.col("node") == F.col("t_node")) & F.col("least").eqNullSafe(F.col("t_id")))
    sets = found.select("node", "comp", "tiles", "sig", "text").mapInArrow(_sets, "node long, comp long, tiles int, sig binary, shingles binary")
    sets = sets.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    meet = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("comp", F.least("tile", "o").alias("a"), F.greatest("tile", "o").alias("b"), "node", "tile", "sig", "shingles")
    # repeated rows (equal doc_id and text) would come twice
    meet = meet.repartition(n, "comp", "a", "b").dropDuplicates(["comp", "a", "b", "node"]).sortWithinPartitions("comp", "a", "b", "node")
    links = written(meet.mapInArrow(_compare, "node long, root long, links long"))
    linked = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = nodes.select("node", "least", "n_equal").join(groups, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known)
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(classes, "root").select(F.col("node").alias("k_node"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_equal")
    return sketches.select("doc_id", "node").join(known, F.col("node") == F.col("k_node")).select("doc_id", "node", "class_id", "n_links", "n_equal")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class: that of the smallest doc_id (one of them, where rows are repeated). Null and empty
    texts are one class; an empty table stays empty; other columns stay as they are."""
    kept, node = unused(docs, "kept", "node")
    found = jaccard_join(docs.select("doc_id", "text")).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = written(found.groupBy(F.col("doc_id").alias(kept), F.col("node").alias(node)).agg(F.count("*").alias("times")))
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    out = docs.join(keep.drop("times"), F.col("doc_id").eqNullSafe(F.col(kept)) & (own == F.col(node)), "left_semi")
    if keep.filter("times > 1").isEmpty():
        return out
    return out.withColumn(node, own).dropDuplicates(["doc_id", node]).drop(node)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_equal")
