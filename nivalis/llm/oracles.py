"""DuckDB SQL for the queries that SQL can express."""

from nivalis.llm.licenses import NOTICES, PHRASES as LICENSE_PHRASES

WORDS = r"[^\x20\x09-\x0D]+"
ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f USING (k), range(13) r(j) WHERE m < doc_id),
x AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
y AS (SELECT x.doc_id, x.p, x.word, c.p IS NOT NULL AS gone FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM y GROUP BY doc_id) USING (doc_id)
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORDS}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORDS}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, z, array_to_string(ws[i:i + z - 1], ' ') AS k FROM (SELECT item, ws, least(13, len(ws)) AS z, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT z FROM bw),
dw AS (SELECT doc_id, z, i, array_to_string(ws[i:i + z - 1], ' ') AS k FROM (SELECT doc_id, ws, z, unnest(range(1, len(ws) - z + 2)) AS i FROM d, sizes)),
h AS (SELECT doc_id, i, dw.z, item FROM dw JOIN bw ON bw.z = dw.z AND bw.k = dw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

# CRC-32 of an integer's decimal text, by its table of 256 remainders (a list, `crcs.t`)
CRC_TABLE = "crcs AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))"


def crc32(number: str) -> str:
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


PREFIX_TRIE = f"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT DISTINCT conv_id, n, conv_id - conv_id % 20 AS p FROM turns),
c1 AS (SELECT conv_id, n, p, {crc32("conv_id")} % 4 AS h FROM c0, crcs),
c2 AS (SELECT c.conv_id, c.p, c.h, least(c.h, coalesce(f.n, 0)) AS k FROM c1 c LEFT JOIN c1 f ON f.conv_id = c.p),
r AS (SELECT conv_id, k + i - h + 1 AS d, role, text FROM turns JOIN c2 USING (conv_id) WHERE i >= h UNION ALL SELECT c.conv_id, i + 1, role, text FROM c2 c JOIN turns t ON t.conv_id = c.p WHERE i < h),
a AS (SELECT conv_id, d, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r UNION ALL SELECT conv_id, 0, '', '' FROM c2),
m AS (SELECT conv_id, d, text, min(conv_id) OVER (PARTITION BY d, k) AS node, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM a),
n AS (SELECT node, d, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '{WORDS}')) AS saved, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids FROM m GROUP BY node, d),
up AS (SELECT n.node, n.d, m.node AS parent FROM n JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM up GROUP BY 1, 2),
w AS (SELECT n.node, n.d, n.n_convs, n.saved, n.ids, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node, d)),
s AS (SELECT m.node, m.d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM w JOIN m ON m.conv_id = w.node AND m.d <= w.d GROUP BY 1, 2)
SELECT w.node AS conv_id, w.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s USING (node, d) LEFT JOIN up USING (node, d)
"""

_ROWS = ", ".join(f"({i}, '{t.label}', {t.words!r}, {t.gram}, {t.share}, {t.slack}, {t.phrase})" for i, t in enumerate(LICENSE_PHRASES + NOTICES))
LICENSES = f"""
WITH t AS (SELECT * FROM (VALUES {_ROWS}) x(id, label, ws, gram, share, slack, phrase)),
tg AS (SELECT id, gram, p, array_to_string(ws[p + 1:p + gram], ' ') AS g FROM (SELECT *, unnest(range(len(ws) - gram + 1)) AS p FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORDS}') AS ws FROM documents),
dg AS (SELECT r, gram, i, array_to_string(ws[i + 1:i + gram], ' ') AS g FROM (SELECT r, ws, gram, unnest(range(len(ws) - gram + 1)) AS i FROM d, (SELECT DISTINCT gram FROM t))),
v AS (SELECT r, id, i - p AS diagonal, i, p, gram FROM dg JOIN tg USING (gram, g)),
b AS (SELECT r, id, diagonal, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, id ORDER BY diagonal) > slack, TRUE) AS new FROM (SELECT DISTINCT r, id, diagonal FROM v) JOIN t USING (id)),
c AS (SELECT r, id, diagonal, sum(CAST(new AS INT)) OVER (PARTITION BY r, id ORDER BY diagonal) AS place FROM b),
e AS (SELECT r, id, place, min(i) AS begins, count(DISTINCT p + j) AS n FROM (SELECT *, unnest(range(gram)) AS j FROM v) JOIN c USING (r, id, diagonal) GROUP BY 1, 2, 3),
f AS (SELECT r, label, phrase, begins, n / len(ws) AS score, share FROM e JOIN t USING (id) WHERE NOT phrase OR n = len(ws)),
g AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(begins) FILTER (phrase) AS first_word, max(begins) FILTER (phrase) AS last_word, max(score) AS score, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (score >= share) AS labels FROM f GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (r)
"""

_LEAF = lambda text: "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
BELOW, ABOVE = 7, 3  # levels that the SQL spells out: 8^7 documents a language, 8^3 languages


def _levels(name: str, tree: str, n: int) -> str:
    """{name}1 ... {name}n from {name}0 (tree, i, n, d), and siblings {name}s0 ... of their nodes."""
    out = []
    for k in range(n):
        out.append(f"{name}s{k} AS (SELECT {tree}, i, n > 1 AS up, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {name}{k} WINDOW w AS (PARTITION BY {tree}, i // 8 ORDER BY i))")
        out.append(f"{name}{k + 1} AS (SELECT {tree}, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}{k} GROUP BY {tree}, i // 8, n)")
    return ",\n".join(out)


def _fold(name: str, tree: str, n: int, before: str, place: str) -> str:
    """{before}, folded n levels up: {name}f1 ... {name}fn."""
    out = []
    for k in range(n):
        prev = f"{name}f{k}" if k else before
        out.append(f"{name}f{k + 1} AS (SELECT x.* REPLACE (CASE WHEN up THEN sha256(a || f || z) ELSE f END AS f, CASE WHEN up THEN p || a || z ELSE p END AS p) FROM {prev} x JOIN {name}s{k} s ON s.{tree} = x.{tree} AND s.i = x.{place} // {8**k})")
    return ",\n".join(out)


MERKLE = f"""
WITH {CRC_TABLE},
l AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_LEAF("text")} AS leaf, CASE WHEN {crc32("doc_id")} % 3 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents, crcs),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
a0 AS (SELECT tree, i, n, leaf AS d FROM o),
{_levels("a", "tree", BELOW)},
b0 AS (SELECT 0 AS one, tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a{BELOW}),
{_levels("b", "one", ABOVE)},
x AS (SELECT o.doc_id, o.leaf, o.tree, o.i, 0 AS one, b0.i AS j, b0.d AS subroot, coalesce(o.changed, o.leaf) AS f, '' AS p FROM o JOIN b0 ON b0.tree = o.tree),
{_fold("a", "tree", BELOW, "x", "i")},
{_fold("b", "one", ABOVE, f"af{BELOW}", "j")}
SELECT doc_id, leaf, subroot, d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = d AS verified FROM bf{ABOVE}, (SELECT d FROM b{ABOVE})
"""

ORACLE = {"op1_decontaminate": DECONTAMINATE, "op7_phrases": PHRASES, "op11_prefix_trie": PREFIX_TRIE, "op12_licenses": LICENSES, "op13_merkle": MERKLE}
