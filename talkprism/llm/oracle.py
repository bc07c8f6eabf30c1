"""DuckDB SQL for the rows of those corpus queries that it expresses."""

from __future__ import annotations

from talkprism.llm import quality_rules

_WORDS = r"""words AS (SELECT doc_id, "text" AS t, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words)"""

#: Windows as joined texts; a word goes if a window over it starts in a document of smaller doc_id.
OP2_SQL = f"""WITH {_WORDS},
gram AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM words WHERE len(w) >= 13),
least AS (SELECT g, min(doc_id) AS owner FROM gram GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM gram JOIN least USING (g) WHERE owner < doc_id)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS line FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def op5_sql(ngram_limits, again_limits, line_limit, min_words, base_percent):
    """Words inside repeated n-grams by their places, and the verdict; limits in doubles, as Spark compares them."""
    sizes = list(ngram_limits)
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, unnest(range(1, len(w) - {n - 2})) AS i, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM words WHERE len(w) >= {n}" for n in sizes
    )
    covered = lambda name, which: f"{name} AS (SELECT doc_id, n, count(*) AS words, sum(length(x)) AS chars FROM (SELECT DISTINCT doc_id, n, i + k AS i FROM (SELECT doc_id, n, i, unnest(range(0, n)) AS k FROM rep WHERE {which})) JOIN word USING (doc_id, i) GROUP BY ALL)"
    columns = ", ".join([f"coalesce(sum(d.chars) FILTER (WHERE d.n = {n}), 0)::bigint AS dup_chars_{n}" for n in sizes] + [f"coalesce(sum(a.chars) FILTER (WHERE d.n = {n}), 0)::bigint AS again_chars_{n}" for n in sizes])
    limits = " AND ".join([f"dup_line_chars <= {line_limit}::double * word_chars", *[f"coalesce(dup_chars_{n}, 0) <= {x}::double * word_chars" for n, x in ngram_limits.items()], *[f"coalesce(again_chars_{n}, 0) <= {x}::double * word_chars" for n, x in again_limits.items()]])
    every = ", ".join(f"coalesce({c}_{n}, 0) AS {c}_{n}" for c in ("dup_chars", "again_chars") for n in sizes)
    return rf"""WITH {_WORDS},
gram AS ({grams}),
rep AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS place FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
{covered("dup", "TRUE")}, {covered("again", "place > 1")},
wide AS (SELECT d.doc_id, coalesce(sum(d.words) FILTER (WHERE d.n = 5), 0)::bigint AS n_repeat_words, {columns} FROM dup d JOIN again a ON d.doc_id = a.doc_id AND d.n = a.n GROUP BY d.doc_id),
line AS (SELECT doc_id, l, count(*) AS times FROM (SELECT doc_id, unnest(string_split(coalesce(t, ''), chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
lines AS (SELECT doc_id, sum(times - 1)::bigint AS n_dup_lines, sum((times - 1) * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))::bigint AS dup_line_chars FROM line GROUP BY doc_id),
stats AS (SELECT doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(coalesce(t, ''), '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols FROM words),
rows AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {every} FROM stats LEFT JOIN lines USING (doc_id) LEFT JOIN wide USING (doc_id))
SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {base_percent} * n_words AS base_failed, NOT (n_words < {min_words} OR 100 * n_repeat_words > {base_percent} * n_words) AND {limits} AS kept FROM rows"""


#: Equal tokens by document, item and shift; then the windows of the item that are laid wholly over the document.
OP7_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce("text", '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce("text", '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dt AS (SELECT doc_id, len(w) AS size, unnest(range(0, len(w))) AS p, unnest(w) AS x FROM d),
bt AS (SELECT item_id, least(13, len(w)) AS width, len(w) AS size, unnest(range(0, len(w))) AS q, unnest(w) AS x FROM b),
eq AS (SELECT doc_id, item_id, p - q AS shift, q, any_value(dt.size) AS doc_size, any_value(bt.size) AS item_size, any_value(width) AS width FROM dt JOIN bt USING (x) GROUP BY doc_id, item_id, p, q),
shifts AS (SELECT doc_id, item_id, shift, any_value(doc_size) AS doc_size, any_value(item_size) AS item_size, any_value(width) AS width, list(q) AS qs FROM eq GROUP BY doc_id, item_id, shift HAVING count(*) >= 0.8 * any_value(width)),
windows AS (SELECT *, unnest(range(greatest(0, -shift), least(item_size, doc_size - shift) - width + 1)) AS a FROM shifts),
scored AS (SELECT doc_id, item_id, shift + a AS start, width, len(list_filter(qs, lambda q: q >= a AND q < a + width)) AS n_equal FROM windows)
SELECT doc_id, item_id, start, n_equal::bigint AS n_equal, width::bigint AS n_compared FROM scored WHERE n_equal >= 0.8 * width - 1e-9
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start) = 1"""

#: CRC-32 of a text of ASCII characters, by a table of 256 remainders.
_CRC = """crc AS (SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS t)"""


def _crc(text):
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295)"


#: Nodes by their whole sequences of turns; every node adds to all its ancestors.
OP11_SQL = f"""WITH {_CRC},
turns AS (SELECT conv_id, {{'r': coalesce(role, ''), 'x': coalesce("text", '')}} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_crc("c::varchar")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM turns), crc),
rebuilt AS (SELECT c, 0 AS part, i, said FROM convs JOIN turns ON conv_id = c - c % 5 AND i <= h UNION ALL SELECT c, 1, i, said FROM convs JOIN turns ON conv_id = c AND i > h),
whole AS (SELECT c, list(said ORDER BY part, i) FILTER (i IS NOT NULL) AS s FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c),
path AS (SELECT c, coalesce(s, []) AS s FROM whole),
occurrence AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM path),
node AS (SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * strlen(any_value(s[d]).x), 0) AS own, coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (d = len(s)), '') AS ends FROM occurrence GROUP BY s[1:d], d),
child AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY p[1:d - 1], d - 1),
flagged AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON node.d = child.d AND node.p = child.p),
up AS (SELECT p, own, n_children, unnest(range(0, d + 1)) AS d FROM flagged),
below AS (SELECT p[1:d] AS p, d, sum(own)::bigint AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY p[1:d], d)
SELECT f.conv_id, f.d AS depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves, below.saved_tokens, sha256(f.ends) AS ends_sha256
FROM flagged f JOIN below ON f.d = below.d AND f.p = below.p LEFT JOIN node parent ON parent.d = f.d - 1 AND parent.p = f.p[1:f.d - 1]"""

#: Groups of equal texts, not of digests.
OP12_SQL = r"""WITH plain AS (SELECT doc_id, regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]', '', 'g') AS p, length(coalesce("text", '')) AS points FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY p) AS group_size, row_number() OVER best = 1 AS kept, sha256(p) AS text_sha256 FROM plain
WINDOW best AS (PARTITION BY p ORDER BY points DESC, doc_id NULLS LAST)"""


def _op13_sql(columns):
    value = lambda x: f"coalesce(strlen({x})::varchar || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else f'"{c}"::varchar') for c in columns) + ")"
    bare = """replace("text", chr(10), '')"""
    tree = lambda name, leaves: f"{name} AS (SELECT tree, 0 AS level, i AS place, n AS width, h FROM {leaves} UNION ALL SELECT tree, level + 1, place // 3, (any_value(width) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE width > 1 GROUP BY tree, level, place // 3)"
    side = lambda sign: f"coalesce(string_agg(x.h, '' ORDER BY x.place) FILTER (x.place {sign} pos), '')"
    path = lambda name, nodes, leaves: f"""{name}_at AS (SELECT l.tree, l.i, m.level, l.i // (3 ** m.level)::bigint AS pos FROM {leaves} l JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE width > 1) m USING (tree)),
{name} AS (SELECT tree, i, list({{'b': b, 'a': a}} ORDER BY level) AS path FROM (SELECT s.tree, s.i, s.level, {side("<")} AS b, {side(">")} AS a FROM {name}_at s JOIN {nodes} x ON x.tree = s.tree AND x.level = s.level AND x.place // 3 = s.pos // 3 GROUP BY s.tree, s.i, s.level, pos) GROUP BY tree, i)"""  # noqa: E731
    none = "[]::STRUCT(b VARCHAR, a VARCHAR)[]"
    return f"""WITH RECURSIVE {_CRC},
rows AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '.' || source END AS tree, {leaf('"text"')} AS h, CASE WHEN {_crc("doc_id::varchar")} % 2 = 0 THEN {leaf(bare)} END AS bare FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows),
{tree("node", "leaves")},
roots AS (SELECT tree AS own, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM node WHERE width = 1),
{tree("high", "roots")},
{path("low", "node", "leaves")},
{path("top", "high", "roots")},
found AS (SELECT l.doc_id, l.h AS leaf, r.h AS subroot, (SELECT h FROM high WHERE width = 1) AS root, coalesce(l.bare, l.h) AS start, list_concat(coalesce(low.path, {none}), coalesce(top.path, {none})) AS path
FROM leaves l JOIN roots r ON r.own = l.tree LEFT JOIN low ON low.tree = l.tree AND low.i = l.i LEFT JOIN top ON top.i = r.i),
folded AS (SELECT *, list_reduce(list_concat([{{'b': start, 'a': ''}}], path), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


#: Nodes level by level, the siblings of every level on both sides, and the fold over them.
OP13_SQL = _op13_sql(("doc_id", "source", "lang", "n_chars", "text"))

ORACLE_SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op5_quality_rules": op5_sql(quality_rules.NGRAM_LIMITS, quality_rules.AGAIN_LIMITS, quality_rules.LINE_LIMIT, quality_rules.MIN_WORDS, quality_rules.BASE_PERCENT),
    "op7_decontamination": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
