"""Prefix trie, license scan and Merkle manifest against brute force, and against DuckDB on the smallest tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from nivalis.llm import contraction, conversations, licenses, merkle
from nivalis.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_licenses", "op13_merkle"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.select(*names)) == sorted(str(r) for r in want.fetchall())


# ---- op11 ----------------------------------------------------------------------------------------------------------


def trie_of(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    members, kids, ends = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in own.items():
        h, first = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        v = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[: d - 1]].add(v[:d])
        ends[v].append(c)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(SPACE.findall(k[-1][1])) if k else 0)
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))))
    return sorted(map(str, out))


def talk(n):
    rng = random.Random(n)
    said = ["", "hello there", "what is  it", "yes", "no\tnever", "größe", "a " * 3000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in range(-25, n) for t in range(rng.randint(1, 7)) if c % 20 or c % 3]
    rows += [(500, None, "user", "hello there"), (500, None, "user", "hello there"), (500, 1, None, None), (None, 1, "user", "lost"), (10**18, 0, "user", None)]
    return rows + [(3, t, "user", "on and on") for t in range(7, 90)]  # a long chain


def test_prefix_trie(spark, monkeypatch):
    rows = talk(120)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    monkeypatch.setattr(conversations, "_large", lambda n: 5)  # hot keys take their own way
    monkeypatch.setattr(conversations, "read", lambda *_: df)
    assert rows_of(conversations.op11_prefix_trie(spark, "")) == trie_of(rows)
    monkeypatch.setattr(conversations, "read", lambda *_: df.limit(0))
    assert conversations.op11_prefix_trie(spark, "").count() == 0


def test_contraction(spark):
    """A chain of 300 nodes, a hub of 200 leaves at its end, a second root, and a null value."""
    up = {i: i - 1 if i else None for i in range(300)} | {1000 + i: 299 for i in range(200)} | {5000: None}
    value = {i: i % 7 for i in up}
    df = spark.createDataFrame([(i, p, value[i] if i % 7 else None, "x") for i, p in up.items()], "id long, parent long, v long, kids string")
    want = dict(value)
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            want[up[i]] += want[i]
    assert {r.id: r.v for r in contraction.subtree_sums(df, ["v"]).collect()} == want
    with pytest.raises(RuntimeError):
        contraction.subtree_sums(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, parent long, v long"), ["v"], most=3)


# ---- op12 ----------------------------------------------------------------------------------------------------------


def licensed(rows):
    templates, out = licenses.PHRASES + licenses.NOTICES, []
    for i, text in rows:
        ws, base, labels, best = WORD.findall(low(text or "")), [], set(), 0.0
        for t in templates:
            tw = WORD.findall(low(t.text))
            if t.phrase:
                at = [p for p in range(len(ws) - len(tw) + 1) if ws[p : p + len(tw)] == tw]
                base += [(p, t.label) for p in at]
                labels |= {t.label} if at else set()
                best = max(best, float(bool(at)))
                continue
            votes = collections.defaultdict(set)
            for d in range(len(ws) - t.gram + 1):
                for p in range(len(tw) - t.gram + 1):
                    if ws[d : d + t.gram] == tw[p : p + t.gram]:
                        votes[d - p].add(p)
            last, held = None, set()
            for d in [*sorted(votes), None]:
                if last is not None and (d is None or d - last > len(tw) // 4):
                    score = len({x + j for x in held for j in range(t.gram)}) / len(tw)
                    best, held = max(best, score), set()
                    labels |= {t.label} if score >= t.share else set()
                held |= votes[d] if d is not None else set()
                last = d
        at = [p for p, _ in base]
        out.append((i, len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best))
    return sorted(map(str, out))


def test_licenses(spark, monkeypatch):
    mit, isc = licenses.NOTICES[4].text, licenses.NOTICES[8].text
    rows = [(1, mit), (1, mit), (2, mit.replace("free of charge", "").replace("publish, ", "publish and also ")), (3, None), (None, "MIT License"), (4, ""), (5, "Apache License gnu GENERAL public license cc by cc-by"), (6, "w " * 5000 + mit + " é" * 4000 + " " + isc), (7, mit[:100]), (8, "apache"), (9, "license " * 50), (10, "cc by " * 3000), (11, "K cc by nc 4.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("hash", F.lit(1)).repartition(3)
    monkeypatch.setattr(licenses, "read", lambda *_: docs)
    assert rows_of(licenses.op12_licenses(spark, "")) == licensed(rows)
    spans = {r.id: r.spans for r in licenses.scan(docs).collect()}
    assert [(x.start, x.end, x.score) for x in spans[6] if x.score == 1] == [(5000, 5047, 1.0), (9047, 9047 + len(licenses.NOTICES[8].words), 1.0)]
    assert licenses.scan(docs.limit(0)).count() == 0


# ---- op13 ----------------------------------------------------------------------------------------------------------


def manifest_of(rows):
    leaf = lambda values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(ds):
        out = [ds]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        for ds in tree[:-1]:
            s = i // 8 * 8
            yield "".join(ds[s:i]), "".join(ds[i + 1 : s + 8])
            i //= 8

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = levels([leaf(r) for r in by[x]])
    top, out = levels([trees[x][-1][0] for x in langs]), []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            way = [*path(trees[x], i), *path(top, k)]
            f = leaf((*r[:4], r[4] and low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r)
            for a, b in way:
                f = sha(a + f + b)
            out.append((r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), f, f == top[-1][0]))
    return sorted(map(str, out))


DOC = "doc_id long, source string, lang string, n_chars long, text string"


def test_merkle(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", ("en", "de", None, "en")[i % 4], i, f"Text {i}") for i in range(4400)] + [(None, None, "zz", None, None), (5, "a", "x", 1, ""), (5, "a", "x", 1, ""), (9, "A", "é", 1, "A" * 100000)]
    rows += [(10000 + i, "s", "en", 1, "copy") for i in range(2500)]  # more than a chunk of one language
    docs = spark.createDataFrame(rows, DOC).withColumn("tree", F.lit("x")).withColumn("i", F.lit(1)).repartition(3)
    monkeypatch.setattr(merkle, "read", lambda *_: docs)
    assert rows_of(merkle.op13_merkle(spark, "")) == manifest_of(rows)
    monkeypatch.setattr(merkle, "read", lambda *_: docs.limit(0))
    assert merkle.op13_merkle(spark, "").count() == 0


@pytest.mark.parametrize("n", [1, 8, 9])
def test_small_trees(spark, monkeypatch, n):
    rows = [(i, "s", f"l{i}" if n == 9 else "en", 1, "X") for i in range(n)]
    monkeypatch.setattr(merkle, "read", lambda *_: spark.createDataFrame(rows, DOC))
    assert rows_of(merkle.op13_merkle(spark, "")) == manifest_of(rows)
