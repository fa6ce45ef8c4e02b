"""Merkle manifest of a dataset: lag and lead windows.

A row's leaf is the digest of its columns. The leaves of a group, in order, are the lowest level of its tree; every RUN
consecutive nodes become their digest, until one is left. In each level, columns of fixed lags and leads (1 to 7 nodes, that is
1 to 7 times RUN^level rows), masked by a node's slot in its run and by the run's length, hold its siblings; a run's first
child hashes the parent, and stands for it in the next level.

A window holds CHUNK = RUN^HEIGHT consecutive leaves, so that HEIGHT levels are one sort; what remains of a chunk is a leaf of
the next round. So a group of any size is many tasks' work. The groups' roots are the leaves of one more tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.llm.tables import read, written
from nivalis.operators.ranking import row_numbers

RUN, HEIGHT = 8, 4
CHUNK = RUN**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf_of(columns: list[Column]) -> Column:
    """SHA-256 (hex) of the columns: each `-` if null, else its length in bytes, a colon and itself as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def climb(nodes: DataFrame, tree: str) -> DataFrame:
    """Nodes (tree, i, n, digest, ...), i from 0 to n - 1, with `chunk`, `path` (siblings of the node and of its ancestors in
    its chunk, lowest first) and `top`: in a chunk's first row, what its levels come to."""
    w = W.partitionBy(tree, "chunk").orderBy("i")
    nodes = nodes.withColumn("chunk", F.floor(F.col("i") / CHUNK)).withColumn("d0", F.col("digest"))
    for level in range(HEIGHT):
        step, d = RUN**level, f"d{level}"
        size = F.ceil(F.col("n") / step)
        slot = F.pmod(F.floor(F.col("i") / step), F.lit(RUN))
        length = F.least(F.lit(RUN), size - (F.floor(F.col("i") / step) - slot))
        node = (F.pmod("i", F.lit(step)) == 0) & (size > 1)
        lags = [F.when(slot >= k, F.lag(d, k * step).over(w)) for k in range(RUN - 1, 0, -1)]
        leads = [F.when(slot + k < length, F.lead(d, k * step).over(w)) for k in range(1, RUN)]
        nodes = nodes.select("*", F.when(node, F.concat_ws("", *lags)).alias(f"left{level}"), F.when(node, F.concat_ws("", *leads)).alias(f"right{level}"))
        parent = F.when(size > 1, F.sha2(F.concat(F.col(d), F.col(f"right{level}")), 256)).otherwise(F.col(d))
        nodes = nodes.withColumn(f"d{level + 1}", F.when(F.pmod("i", F.lit(step * RUN)) == 0, parent))
    # the last node of a level up to a row is the row's ancestor
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    above = [F.last(f"{side}{k}", ignorenulls=True).over(so_far).alias(f"{side}{k}") for k in range(1, HEIGHT) for side in ("left", "right")]
    made = {f"{x}{k}" for k in range(HEIGHT + 1) for x in ("d", "left", "right")}
    filled = nodes.select(*[c for c in nodes.columns if c not in made], F.col(f"d{HEIGHT}").alias("top"), "left0", "right0", *above)
    path = F.filter(F.array(*[F.struct(F.col(f"left{k}").alias("left"), F.col(f"right{k}").alias("right")) for k in range(HEIGHT)]), lambda x: x["left"].isNotNull())
    return filled.select(*[c for c in filled.columns if c not in made], path.alias("path"))


def grown(leaves: DataFrame, tree: str) -> tuple[DataFrame, DataFrame]:
    """(roots, above) of the trees of leaves (tree, i, n, digest): roots (tree, digest), and for each chunk of leaves the path from
    it to the root: (tree, chunk, above)."""
    rounds, most = [], leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select(tree, "i", "n", "digest")
    while True:  # the number of rounds is logarithmic, to the base CHUNK
        nodes = written(climb(nodes, tree).filter(F.pmod("i", F.lit(CHUNK)) == 0).select(tree, F.col("chunk").alias("i"), F.ceil(F.col("n") / CHUNK).alias("n"), F.col("top").alias("digest")))
        rounds.append(nodes)
        most = -(-most // CHUNK)
        if most <= 1:
            break
    above = nodes.select(tree, F.col("i").alias("chunk"), F.array().cast(PATH).alias("above"))
    for below in reversed(rounds[:-1]):
        above = climb(below, tree).join(above, [tree, "chunk"]).select(tree, F.col("i").alias("chunk"), F.concat("path", "above").alias("above"))
    return nodes.select(tree, "digest"), above


def manifest(docs: DataFrame, columns=COLUMNS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, path, and the columns `keep`): one row for each row of `docs`.

    `columns` make the leaf. Leaves of a group ascend by `order` (null first; rows of equal `order` by their digest; equal
    rows each have a leaf). A null group is a group, the first; groups ascend bytewise. `path` lists the siblings, left
    and right of the node, from the leaf to the root of all. Empty and long texts are values like others; an empty table
    has an empty manifest. Other columns of `docs` are left out."""
    keep = keep or {}
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))  # sorts null first
    kept = [c.alias(f"k{j}") for j, c in enumerate(keep.values())]
    rows = written(docs.select(key.alias("tree"), F.col(f"`{order}`").alias("place"), leaf_of([F.col(f"`{c}`") for c in columns]).alias("digest"), *kept))
    leaves = row_numbers(rows, ["place", "digest"], ["tree"], "i", "n")
    subroots, above = grown(leaves, "tree")
    subroots = row_numbers(subroots.withColumnRenamed("digest", "subroot"), ["tree"], name="i", count="n").select(F.lit(0).alias("all"), "tree", "i", "n", F.col("subroot").alias("digest"))
    root, higher = grown(subroots, "all")
    last = climb(subroots, "all").join(higher, ["all", "chunk"]).join(F.broadcast(root.select("all", F.col("digest").alias("root"))), "all")  # one row
    last = last.select("tree", F.col("digest").alias("subroot"), "root", F.concat("path", "above").alias("higher"))
    above = above.join(last, "tree").select("tree", "chunk", F.concat("above", "higher").alias("above"), "subroot", "root")
    # the windows of `climb` and this join deal rows alike: leaves move once
    out = climb(leaves, "tree").join(above, ["tree", "chunk"])
    return out.select(F.col("place").alias(order), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path"), *[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def lower(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    upper = [chr(c) for c in range(65, 91)]
    return F.when(text.rlike("[A-Z]"), F.translate(text, "".join(upper), "".join(upper).lower())).otherwise(text)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether a tampered copy still proves it. A null id isn't tampered with."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    changed = leaf_of([lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, changed)
    out = manifest(docs, keep={"tampered": tampered}).withColumn("proof_sha256", proof(F.col("path")))
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
