"""GeoJSON features, one large file read by many tasks.

A file is cut where Spark cuts it, and in each part into pieces that end with `}`. A `}` is never escaped, so the state of the
reader between two pieces is only whether a string is open, and the brackets that are. The first pass says of each part, for
either beginning, what it closes and opens: a row a part. Those rows give the state at the beginning of every part, and the
second pass cuts out the features; those that lie in several parts are put together by the part they begin in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A string, whole or open at the end, with what follows if an array is its value; or a bracket.
TOKEN = re.compile(r'"(?P<text>[^"\\]*(?:\\.[^"\\]*)*)(?P<end>"(?P<array>\s*:\s*\[)?|\Z)|[{}\[\]]', re.S)
STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: Open brackets within the features of a collection; `F` is an array by the name of features.
FEATURES = "{F"


def _tokens(text: str, inside: bool) -> Iterator[tuple[str, int]]:
    """(bracket, where) outside of strings; `"` stands for a string that stays open."""
    at = 0
    if inside:
        end = STRING_END.match(text)
        if end is None:
            yield '"', len(text)
            return
        at = end.end()
    for m in TOKEN.finditer(text, at):
        if m["text"] is None:
            yield m[0], m.start()
        elif not m["end"]:
            yield '"', m.start()
        elif m["array"]:
            yield "F" if m["text"] == "features" else "[", m.end() - 1


class _Reader:
    """Open brackets, how many were closed that it hasn't seen opened, and whether a string is open."""

    def __init__(self, inside: bool = False, stack: str = ""):
        self.inside, self.stack, self.closes = inside, list(stack), 0

    def take(self, text: str) -> int | None:
        """Reads a piece; where in it a feature begins, if one does."""
        was, self.inside, begins = self.inside, False, None
        for t, at in _tokens(text, was):
            if t == '"':
                self.inside = True
            elif t in "}]":
                if self.stack:
                    self.stack.pop()
                else:
                    self.closes += 1
            else:
                self.stack.append(t)
                if t == "{" and len(self.stack) == 3 and "".join(self.stack[:2]) == FEATURES:
                    begins = at
        return begins

    @property
    def at_features(self) -> bool:
        return len(self.stack) == 2 and "".join(self.stack) == FEATURES

    @property
    def in_feature(self) -> bool:
        return "".join(self.stack[:3]) == FEATURES + "{"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def told(key, readers):
        return pd.DataFrame({"file": key[0], "part": [key[1]], **{f"{c}{k}": [v] for k, r in enumerate(readers) for c, v in (("closes", r.closes), ("opens", "".join(r.stack)), ("inside", r.inside))}})

    key, readers = None, []
    for pdf in batches:
        for file, part, text in zip(pdf.file, pdf.part, pdf.text, strict=True):
            if (file, part) != key:
                if key:
                    yield told(key, readers)
                key, readers = (file, part), [_Reader(False), _Reader(True)]
            for r in readers:
                r.take(text)
    if key:
        yield told(key, readers)


def _states(parts: pd.DataFrame) -> pd.DataFrame:
    """The state at the beginning of each part of a file, and the part in which the feature that is open there begins."""
    inside, stack, owner, rows = 0, "", -1, []
    for r in parts.sort_values("part").to_dict("records"):
        rows.append((r["file"], r["part"], bool(inside), stack, owner))
        left = len(stack) - r[f"closes{inside}"]
        goes_on = stack.startswith(FEATURES + "{") and left > 2  # the feature that was open isn't closed
        stack = stack[: max(left, 0)] + r[f"opens{inside}"]
        owner = owner if goes_on else r["part"]
        inside = int(r[f"inside{inside}"])
    return pd.DataFrame(rows, columns=["file", "part", "inside", "stack", "owner"])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, owner, part, whole, last, text): whole features, and what lies in this part of others. A part's first row is its state."""
    names = ["file", "owner", "part", "whole", "last", "text"]
    key, reader, owner, held, out = None, None, -1, [], []

    def rest():
        return [(key[0], owner, key[1], False, False, "".join(held))] if held else []

    for pdf in batches:
        for file, part, text, inside, stack, own in zip(*[pdf[c] for c in ("file", "part", "text", "inside", "stack", "owner")], strict=True):
            if (file, part) != key:
                out += rest()
                key, reader, owner, held = (file, part), _Reader(bool(inside), stack), int(own), []
                continue
            within = reader.in_feature
            begins = reader.take(text)
            if within:
                held.append(text)
            elif begins is not None:
                held, owner = [text[begins:]], part
            if held and reader.at_features:
                out.append((file, owner, part, owner == part, True, "".join(held)))
                held = []
        if out:
            yield pd.DataFrame(out, columns=names)
            out = []
    if out := out + rest():
        yield pd.DataFrame(out, columns=names)


def feature_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): each object among the features of each collection in the files (a file may hold several). What else is
    there, null features and a feature that the file doesn't finish are left out; empty files have none."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.concat("value", F.lit("}")).alias("text")
    )
    summary = ", ".join(f"closes{k} long, opens{k} string, inside{k} boolean" for k in (0, 1))
    parts = raw.mapInPandas(_summaries, f"file string, part long, {summary}")
    states = parts.groupBy("file").applyInPandas(_states, "file string, part long, inside boolean, stack string, owner long")  # a row a part
    rows = raw.withColumn("n", F.monotonically_increasing_id()).unionByName(states.withColumn("n", F.lit(-1).cast("long")), allowMissingColumns=True)
    ordered = rows.repartition("file", "part").sortWithinPartitions("file", "part", "n")
    cut = ordered.mapInPandas(_features, "file string, owner long, part long, whole boolean, last boolean, text string")
    piece = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = cut.filter("not whole").groupBy("file", "owner").agg(F.array_join(F.transform(piece, lambda x: x["text"]), "").alias("text"), F.bool_or("last").alias("last"))
    return cut.filter("whole").select("file", "text").unionByName(joined.filter("last").select("file", "text"))
