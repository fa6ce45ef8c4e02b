"""Secrets at any share of the candidates, mixes of many small sources, language scores of any layout and of large counts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalis import session
from nivalis.llm import language, mixing, secrets

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYLLABLES = ["tion", "heit", "ver", "en", "er", "an", "th", "re", "ing", "ea", "on", "de", "st", "es", "ti"]


def candidate(rng, secret):
    if secret:
        letters = rng.choice([B64, B64[:62], "0123456789abcdef", B64[26:62], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
        return "".join(rng.choices(letters, k=rng.choice([24, 32, 40, 48])))
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(8, 12)))
    return rng.choice([word, lambda: word().capitalize() + word(), lambda: "path/to/" + word() + "/" + word(), lambda: "x" * rng.randint(20, 40), lambda: word() + str(rng.randint(1, 99))])()


@pytest.mark.parametrize(("n", "share"), [(1000, 0.01), (1000, 0.07), (1000, 0.3), (1000, 0.6), (1000, 0.9), (1000, 1.0), (1000, 0.0), (100_000, 0.01), (100_000, 0.9)])
def test_found_at_any_share(spark, n, share):
    rng = random.Random(n + int(100 * share))
    rows = [(i, f"a {candidate(rng, i < share * n)} b") for i in range(n)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).selectExpr("doc_id", "exists(spans, s -> s.kind = 3) AS hit").filter("hit").collect()
    hit = sum(r.doc_id < share * n for r in got)
    assert hit >= 0.9 * share * n and len(got) - hit <= 0.02 * hit + (1 if share else 0.001 * n)


def test_fit_does_not_depend_on_other_classes():
    words = [(4, 90, 500), (4, 80, 300)]
    tokens = [(5, b, 20) for b in range(0, 40, 2)]
    assert secrets.discoveries(words + tokens)[5] == secrets.discoveries(tokens)[5] > 40
    assert secrets.discoveries([]) == {}
    assert secrets.random_below(0.0) == 0 and secrets.random_below(20.0) == pytest.approx(1)


def test_small_sources_come_near_their_targets(spark):
    rows = [(100 * s + i, f"s{s:02}", 1 + (i * 7 + s) % 3) for s in range(60) for i in range(10)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"))[0].collect()
    taken, target = {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 3 for s in target) and all(r.taken <= 2 * r["size"] for r in out)


def test_mixed_keeps_tiny_sources(spark):
    docs = spark.createDataFrame([(i, "one two three", f"s{i}") for i in range(40)] + [(100, "w " * 5000, "big"), (101, None, "none"), (102, "", None)], "doc_id long, text string, source string")
    kept = {r.source for r in mixing.mixed(docs).collect()}
    assert len(kept - {"big"}) >= 38 and "big" in kept and not kept & {"none", None}


def test_language_does_not_depend_on_the_layout(spark, monkeypatch):
    """Rows as they are, dealt to few and many partitions, and in reverse; several blocks, repeated rows and null ids."""
    monkeypatch.setattr(language, "BLOCK_BYTES", 40_000)
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    rows = [(i if i % 50 else None, " ".join(r.choices(words, k=r.randint(0, 80))) if i % 41 else None) for i in range(700)]
    rows += [(7000, "one and the same text " * 40)] * 120
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda d: sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.score, r.base_score) for r in language.score_texts(d).collect())
    want = told(df)
    assert len(want) == len(rows) and len({x[3] for x in want}) > 500
    assert told(df.repartition(4)) == want and told(df.coalesce(1).orderBy(F.desc("doc_id"))) == want


def test_language_leaves_nothing_but_scores(spark, monkeypatch, tmp_path):
    """Blocks, questions, replies and what was shuffled are deleted; the number of parts changes no score."""
    monkeypatch.setattr(language, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    r = random.Random(8)
    df = spark.createDataFrame([(i, " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(400))) for i in range(300)], "doc_id long, text string")
    before = files()
    found = language.score_texts(df)
    for _ in range(50):  # files are deleted soon after
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 300 * 400
    want = sorted(found.collect())
    monkeypatch.setattr(language, "PARTS", 1)
    assert len(want) == 300 and sorted(language.score_texts(df).collect()) == want


def test_language_states_keep_the_ratio_of_large_counts():
    own, other = np.array([10**8, 2 * 10**4, 3, 10**9, 30_000, 0]), np.array([2 * 10**4, 10**8, 2, 10**9, 0, 10**7])
    odds = language.ODDS[language.state(own, other)]
    assert odds[0] == -odds[1] and abs(odds[0] - np.log(5000)) < 0.5 and odds[3] == 0
    assert odds[2] == np.float32(np.log(3.4 / 2.4)) and odds[4] > 11 and odds[5] == -odds[4]
    assert (language.state(own[2:3], other[2:3]) == (3 << 4 | 2)).all()


def test_documents_are_merged_at_every_size(spark):
    from nivalis.llm import mixing

    docs = spark.createDataFrame([(i, "a b c d", "s") for i in range(20)], "doc_id long, text string, source string")
    assert "strategy=merge" in mixing.mixed(docs)._jdf.queryExecution().optimizedPlan().toString()
