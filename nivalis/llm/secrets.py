"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control. DataFrame functions only.

Every run of 20 or more letters, digits, + and / is a candidate; runs end at _, - and =, so that the value of
`prefix_value` is tested without the prefix. Its encoding (hex, base32, alphanumeric, base64) is inferred, and three
statistics are taken of it against even draws from that encoding: the chi-squared statistic of its alphabet, the number of
runs of character classes, and the lag-1 serial correlation of its codes. The squares of an uneven alphabet, of too few runs and of the
correlation add up to its distance from randomness. How the distance of random runs is distributed is known: it doesn't depend on
the corpus or on the length. In each class of lengths the candidates are taken for a mixture of these and of ordinary ones, whose
logarithms of distance are normal; its share and the ordinary ones' mean and deviation are fitted to the class's histogram, so that
any share of secrets will do. A class's nearest candidates are found, up to where the fit says that the share of ordinary ones among
them reaches `FDR`; a candidate that the battery itself rejects at 0.1 % never is. Candidates inside the fixed patterns' matches are
tested like all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm.tables import let, read, written

#: Fixed values, as the task states them: pattern, pattern whose match must have at least so many characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more
CANDIDATE = r"[A-Za-z0-9+/]{20,}"
KINDS = ("assign", "access", "hex", "random")

FDR = 0.005
WIDTH, CAP = 0.05, 4.8  # bins of the distance's logarithm; what is farther than CAP counts as CAP, for it is ordinary anyway
CLASSES = 32  # of lengths: powers of two
REJECTED = 16.27  # of chi-squared with three degrees of freedom, 0.1 % are above
ORDINARY = (4.2, 0.6)  # mean and deviation of words' logarithms, which count as much as PRIOR candidates of a class
PRIOR = 50
SHARE = (0.5, 4.5)  # random and ordinary candidates that are added to a class's
#: Encodings: letters, share of neighbours of different class (lower, upper, digit, other) in even draws, pattern.
ENCODINGS = [(16, 15 / 32, "^([0-9a-f]+|[0-9A-F]+)$"), (22, 78 / 121, "^[0-9a-fA-F]+$"), (32, 39 / 128, "^[A-Z2-7]+$"), (36, 65 / 162, "^([a-z]*[0-9]){2}[a-z0-9]*$"), (62, 598 / 961, "^[A-Za-z0-9]+$"), (64, 165 / 256, "")]


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    r"""All matches as structs (start, end, text, value), leftmost and non-overlapping; code points, end exclusive.

    \G ties each match to the end of the one before, so that a text is scanned once."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), 0)
    kind = "array<struct<start:int,end:int,text:string,value:string>>"

    def add(acc, piece):
        found = F.regexp_extract(piece, f"(?:{pattern})$", 0)
        end = acc["at"] + F.char_length(piece)
        one = F.struct((end - F.char_length(found)).alias("start"), end.alias("end"), found.alias("text"), (F.regexp_extract(found, f"^(?:{pattern})$", value_group) if value_group else found).alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).cast(kind).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(pieces, start, add, lambda acc: acc["out"])


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def battery(s: Column) -> Column:
    """(length_class, uneven_z, runs_z, serial_z, distance) of a candidate; the distance's logarithm is smaller the more random it looks."""

    def tested(chars):
        n = F.size(chars).cast("double")
        letters, change = (F.when(F.lit(False), None) for _ in range(2))
        for size, share, pattern in ENCODINGS:
            letters, change = letters.when(s.rlike(pattern), float(size)), change.when(s.rlike(pattern), share)
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(F.lit(1.0) * (n - F.char_length(F.replace(s, c, F.lit("")))), 2.0))
        chi2 = letters / n * squares - n
        # Wilson and Hilferty's normal score of the chi-squared statistic
        uneven_z = (F.pow(F.greatest(chi2, F.lit(0.0)) / (letters - 1), 1 / 3) - (1 - 2 / (9 * (letters - 1)))) / F.sqrt(2 / (9 * (letters - 1)))
        classes = F.translate(s, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "l" * 26 + "u" * 26 + "d" * 10 + "o" * 2)
        runs = F.char_length(F.regexp_replace(classes, r"(.)\1*", "x")).cast("double")
        runs_z = (runs - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        codes = F.transform(chars, lambda ch: F.ascii(ch).cast("double"))

        def serial(x):
            mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
            var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
            cov = F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, v: a + v)
            return F.when(var > 0, cov / var).otherwise(F.lit(1.0))

        serial_z = let(codes, serial) * F.sqrt(n)
        far = F.pow(F.greatest(uneven_z, F.lit(0.0)), 2.0) + F.pow(F.least(runs_z, F.lit(0.0)), 2.0) + F.pow(serial_z, 2.0)
        return F.struct(F.least(F.floor(F.log2(n)), F.lit(CLASSES - 1)).cast("int").alias("length_class"), uneven_z.alias("uneven_z"), runs_z.alias("runs_z"), serial_z.alias("serial_z"), F.log1p(far).alias("distance"))

    return let(F.split(s, "", F.char_length(s)), tested)


def random_below(distance: float) -> float:
    """The share of random runs whose distance's logarithm is below: two squares count on one side only, one on both."""
    x = math.expm1(distance)
    one = math.erf(math.sqrt(x / 2))
    return one / 4 + (1 - math.exp(-x / 2)) / 2 + (one - math.sqrt(2 * x / math.pi) * math.exp(-x / 2)) / 4


def _normal_below(x: float, mean: float, deviation: float) -> float:
    return 0.5 * math.erfc((mean - x) / deviation / math.sqrt(2))


def mixture(counts: dict[int, int], steps: int = 300) -> tuple[float, float, float]:
    """(share of random ones, mean and deviation of the ordinary ones) of a class's bins, by expectation and maximisation."""
    share, (mean, deviation), n = 0.1, ORDINARY, sum(counts.values())
    for _ in range(steps):
        random = {}
        for b in counts:
            r = share * max(random_below((b + 1) * WIDTH) - random_below(b * WIDTH), 1e-12)
            o = (1 - share) * max(_normal_below((b + 1) * WIDTH, mean, deviation) - _normal_below(b * WIDTH, mean, deviation), 1e-12)
            random[b] = r / (r + o)
        ordinary = {b: c * (1 - random[b]) for b, c in counts.items()}
        weight, before = sum(ordinary.values()) + PRIOR, (share, mean)
        share = (n - weight + PRIOR + SHARE[0]) / (n + sum(SHARE))
        mean = (PRIOR * ORDINARY[0] + sum(w * (b + 0.5) * WIDTH for b, w in ordinary.items())) / weight
        squares = sum(w * ((b + 0.5) * WIDTH - mean) ** 2 for b, w in ordinary.items())
        deviation = max(math.sqrt((PRIOR * (ORDINARY[1] ** 2 + (ORDINARY[0] - mean) ** 2) + squares) / weight), 0.2)
        if abs(share - before[0]) + abs(mean - before[1]) < 1e-7:
            break
    return share, mean, deviation


def discoveries(counts: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Highest bin that is found, by length class; counts: (class, bin, number of candidates)."""
    out = {}
    for cls in {c for c, _, _ in counts}:
        share, mean, deviation = mixture({b: n for c, b, n in counts if c == cls})
        for b in range(math.ceil(math.log1p(REJECTED) / WIDTH)):
            ordinary = (1 - share) * _normal_below((b + 1) * WIDTH, mean, deviation)
            if ordinary <= fdr * (ordinary + share * random_below((b + 1) * WIDTH)):
                out[cls] = b
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs`' other columns with n_assign, n_access, n_hex, base and spans (arrays of start, kind, end, in order).

    A null text is an empty one; texts without matches have empty arrays. Existing columns of these names are replaced."""
    made = ["n_assign", "n_access", "n_hex", "base", "spans", "tests"]
    docs = docs.drop(*[c for c in made if c != text])
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    found = docs.select(*rest, F.filter(matches(body, ASSIGN, 1), lambda m: F.char_length(m["value"]) >= 6).alias("_assign"), matches(body, ACCESS).alias("_access"), matches(body, HEX).alias("_hex"), matches(body, CANDIDATE).alias("_more"))
    base = F.array_sort(F.concat(_spans(F.col("_assign"), "assign"), _spans(F.col("_access"), "access"), _spans(F.col("_hex"), "hex")))
    tests = F.transform("_more", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["text"]).alias("t")))
    kept = written(found.select(*rest, *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base"), tests.alias("tests")))
    each = kept.select(F.explode("tests.t").alias("t"))
    at = lambda t: F.least(F.floor(t["distance"] / WIDTH), F.lit(int(CAP / WIDTH))).cast("int")
    counts = each.groupBy(F.col("t.length_class").alias("c"), at(F.col("t")).alias("b")).agg(F.count("*").alias("n")).collect()  # CLASSES times CAP / WIDTH rows at most
    highest = discoveries([tuple(r) for r in counts])
    bounds = F.array(*[F.lit(highest.get(c, -1)) for c in range(CLASSES)])
    found = F.filter("tests", lambda x: (at(x["t"]) <= F.element_at(bounds, x["t"]["length_class"] + 1)) & (x["t"]["distance"] <= math.log1p(REJECTED)))
    added = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return kept.select(*rest, "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
