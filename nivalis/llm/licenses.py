"""License scans by diagonal voting.

Templates are phrases, and notices that licenses ask to be put into a work. All rolling hashes of k words of all documents are
joined by Spark to the templates' positions; a hit votes, once its words are compared, for a diagonal: where in the document the
template's first word would be. Votes are added up by diagonal; neighbouring diagonals, at most a quarter of the template's words apart,
are merged (words that were put in or left out shift the rest); and a span is verified by the share of the template's words
that its votes cover. A phrase counts where one diagonal holds all of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.llm import blocks as B
from nivalis.llm.decontaminate import PER_BATCH, Words
from nivalis.llm.tables import read, small_batches


@dataclass(frozen=True)
class Template:
    """`share` of the words of `text` must be covered by votes of `gram` words; a `phrase` must be there as it is."""

    label: str
    text: str
    gram: int = 5
    share: float = 0.6
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), self.text))

    @property
    def slack(self) -> int:
        return 0 if self.phrase else len(self.words) // 4


#: Phrases and labels, as the task states them.
PHRASES = (
    Template("gpl", "gnu general public license", 2, 1.0, True),
    Template("apache", "apache license", 2, 1.0, True),
    Template("cc-by", "cc by", 2, 1.0, True),
    Template("mit", "mit license", 2, 1.0, True),
)
#: Names of versions, and the notices that licenses ask for.
NOTICES = (
    Template("gpl-3.0", "gnu general public license version 3", 2, 0.9),
    Template("apache-2.0", "apache license version 2 0", 2, 0.9),
    Template("cc-by-nc-4.0", "cc by nc 4 0", 2, 0.9),
    Template("mit", "released under the mit license", 2, 0.9),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

PIECE = 4096  # words whose hashes are one row
_PIECE = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("words", pa.list_(pa.string())), ("grams", pa.list_(pa.int64()))])
PIECES = "row long, id long, n_words long, first long, n int, words array<string>, grams array<long>"


def _grams(words: Words, n: int) -> np.ndarray:
    """Hashes of each n words in a row, as many as there are words; the last n - 1 are 0."""
    out = np.zeros(len(words.hash), np.int64)
    if len(out) >= n:
        at = np.arange(len(out) - n + 1)
        out[: len(at)] = B.mix64(words.prefix.spans(at, at + n) + B.U(n)).view(np.int64)
    return out


def _pieces(batches, sizes: tuple[int, ...]):
    """Texts as pieces of PIECE words: the words (and the next piece's first), and all hashes of one size after those of another.

    Hashes that reach into the next text are found out when words are compared."""
    for batch in batches:
        rows, ids, texts = (batch.column(k).to_pylist() for k in range(3))
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= PER_BATCH):
                size += len(texts[b])
                b += 1
            words = Words(texts[a:b])
            grams = [_grams(words, n) for n in sizes]
            for t in range(b - a):
                lo, hi = int(words.edge[t]), int(words.edge[t + 1])
                for x in range(lo, max(hi, lo + 1), PIECE):
                    y = min(x + PIECE, hi)
                    spelled = [w.decode("utf-8", "replace") for w in words.spelled(x, min(y + sizes[-1] - 1, hi))]
                    yield B.rows(_PIECE, [[rows[a + t]], [ids[a + t]], [hi - lo], [x - lo], [y - x], [spelled], [np.concatenate([g[x:y] for g in grams])]])
            a = b


def positions(templates: tuple[Template, ...]) -> list[tuple]:
    """(hash, template, position, words of the gram) of all the templates' grams."""
    out = []
    for i, t in enumerate(templates):
        ws = t.words
        hashes = _grams(Words([" ".join(ws).encode()]), t.gram).tolist()
        out += [(hashes[p], i, p, t.gram, " ".join(ws[p : p + t.gram])) for p in range(len(ws) - t.gram + 1)]
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, spans): one row for each row of `docs`, with a number of its own; other columns are left out.

    spans: array of (start, end, template, score), by start, of all that got votes: words from `start` to before `end` hold the share
    `score` of the template's words. Null and empty texts have no words and no spans; ids may be null or repeat; an empty
    table stays empty."""
    spark = docs.sparkSession
    small_batches(spark)
    sizes = tuple(sorted({t.gram for t in templates}))
    rows = docs.select(F.monotonically_increasing_id(), F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    known = F.broadcast(spark.createDataFrame(positions(templates), "hash long, template int, at int, size int, gram string"))  # as many rows as templates have words
    grams = rows.mapInArrow(lambda x: _pieces(x, sizes), PIECES).select("*", F.posexplode_outer("grams").alias("pos", "hash")).join(known, "hash", "left")
    begin = F.pmod("pos", "n")
    same = F.array_join(F.slice("words", begin + 1, F.col("size")), " ") == F.col("gram")
    word = F.col("first") + begin
    # a piece's first hash stays, for texts without votes; from here on all is grouped by row and moves once
    votes = grams.filter((F.coalesce("pos", F.lit(0)) == 0) | same)
    votes = votes.select("row", "id", "n_words", F.when(same, F.struct("template", (word - F.col("at")).alias("diagonal"), word.alias("word"), "at")).alias("v"))
    votes = votes.repartition("row")
    diagonals = votes.groupBy("row", "v.template", "v.diagonal").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.min("v.word").alias("start"), F.max("v.word").alias("end"), F.collect_set("v.at").alias("at"))
    table = F.array(*[F.struct(F.lit(len(t.words)).alias("words"), F.lit(t.gram).alias("gram"), F.lit(t.slack).alias("slack"), F.lit(t.phrase).alias("phrase")) for t in templates])
    diagonals = diagonals.withColumn("t", F.element_at(table, F.col("template") + 1))
    by = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > F.col("t.slack")
    diagonals = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("long")).withColumn("place", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    each = diagonals.select("*", F.explode_outer("at").alias("p"))
    places = each.groupBy("row", "template", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("t").alias("t"), F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("p").alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("t.gram") - 1)))))
    score = covered / F.col("t.words")
    span = F.struct(F.col("start"), (F.col("end") + F.col("t.gram")).alias("end"), "template", score.alias("score"))
    found = F.when(F.col("template").isNotNull() & (~F.col("t.phrase") | (score == 1)), span)  # part of a phrase is nothing
    return places.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_list(found)).alias("spans"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, and labels with those of notices that are there by their share of words; the score is the best share of any template."""
    templates = PHRASES + NOTICES
    of = lambda what: F.array(*[F.lit(what(t)) for t in templates])
    labels, shares = of(lambda t: t.label), of(lambda t: t.share)
    base = F.filter("spans", lambda s: s["template"] < len(PHRASES))
    enough = F.filter("spans", lambda s: s["score"] >= F.element_at(shares, s["template"] + 1))
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.element_at(labels, s["template"] + 1)))), ",")
    starts = F.transform(base, lambda s: s["start"])
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), templates)
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(enough).alias("labels"), best.alias("score"))
