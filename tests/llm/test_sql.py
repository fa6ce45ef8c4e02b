"""Columns of text queries that SQL can express, against DuckDB on the smallest tables."""

import collections
import zlib

import duckdb
import pytest

from nivalis.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT doc_id, coalesce(text, '') AS text FROM '{SF}/documents.parquet'")
    return c


def test_edited_texts(spark, con):
    want = con.sql(
        """WITH n AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next, length(text) AS n FROM documents WINDOW o AS (ORDER BY doc_id)),
        e AS (SELECT doc_id, n, left(text, n - n // 4) || left(next, n // 4) AS edited FROM n) SELECT doc_id, n, sha256(edited) FROM e"""
    ).fetchall()
    out = QUERIES["op9_fingerprints"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    # likeness falls with what is edited, and equal texts have equal fingerprints
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    long = [r for r in out if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    prints = collections.defaultdict(set)
    for r in out:
        prints[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_shards_of_whole_records(spark, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    out = QUERIES["op6_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items())
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    assert all(r.grown_shard in (r.shard, 16) for r in out) and {r.law for r in out} == {"key"}


def test_sizes_and_sources_of_the_mix(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, sum(size) OVER (PARTITION BY source) AS source_size FROM documents").fetchall()
    out = QUERIES["op10_mixing"](spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.source_size) for r in out) == sorted((i, int(n), int(s)) for i, n, s in want)
    assert all(r.taken <= 2 * r["size"] for r in out)


def test_held_out_rows(spark, con):
    ids = [i for (i,) in con.sql("SELECT doc_id FROM documents").fetchall()]
    out = QUERIES["op4_quality"](spark, SF).collect()
    assert {(r.doc_id, r.held_out) for r in out} == {(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in ids}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
