"""DuckDB SQL of the queries that SQL can express."""
from __future__ import annotations

from riskloom.llm import line_dedup, oddsketch, spelling, substring, warc
from riskloom.llm.quality_rules import ALPHA_TOTAL, DELTA, GRID, MAX_REPEAT_PERCENT, MIN_WORDS, WINDOW

W = r"'[^\x20\x09-\x0D]+'"


def _quality_rules() -> str:
    tests = sum(len(c) for c in GRID.values())
    alpha = ALPHA_TOTAL / len(GRID)
    counts, cuts, passes = [], [], []
    for r, grid in GRID.items():
        valid = []
        for i, c in enumerate(grid):
            counts.append(f"count(*) FILTER ({r} > {c!r}) AS k_{r}_{i}")
            valid.append(
                f"CASE WHEN k_{r}_{i} <= n * {alpha!r} AND list_sum(list_transform(range(0, k_{r}_{i} + 1), "
                f"lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha!r}) "
                f"+ (n - j) * ln(1 - {alpha!r})))) <= {DELTA!r} / (strata * {tests}) THEN {c!r} END")
        cuts.append(f"coalesce({', '.join(valid)}) AS cut_{r}")
        passes.append(f"coalesce({r} <= cut_{r}, true)")
    return f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {W}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {W})) AS lines
  FROM documents),
win AS (
  SELECT doc_id, p, w[p:p + {WINDOW - 1}] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM base)),
dup AS (
  SELECT doc_id, unnest(range(p, p + {WINDOW})) AS pos
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM dup GROUP BY doc_id),
m AS (
  SELECT b.doc_id, lang, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN rep ON b.doc_id = rep.doc_id),
r AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_ratio
  FROM m),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (
  SELECT lang, count(*) AS n, {', '.join(counts)}
  FROM r SEMI JOIN good ON r.doc_id = good.doc_id GROUP BY lang),
cutoffs AS (
  SELECT lang, {', '.join(cuts)} FROM (SELECT *, count(*) OVER () AS strata FROM counts)),
judged AS (
  SELECT r.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         {' AND '.join(passes)} AS passes
  FROM r LEFT JOIN cutoffs c ON r.lang IS NOT DISTINCT FROM c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND passes AS kept
FROM judged"""


LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
real AS (
  SELECT doc_id, i, key, len(regexp_extract_all(key, {W})) AS words FROM lines WHERE key <> ''),
docs AS (
  SELECT doc_id, list(key ORDER BY i) AS ks, list(words ORDER BY i) AS ws, list(i ORDER BY i) AS held
  FROM real GROUP BY doc_id),
spans AS (
  SELECT *, unnest(range(s, least(s + {line_dedup.MIN_WORDS}, len(ks) + 1))) AS e
  FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS s FROM docs)),
firsts AS (
  SELECT doc_id, s, e, held[s:e] AS held, min({{'d': doc_id, 's': s}}) OVER (PARTITION BY ks[s:e]) AS f
  FROM spans WHERE list_sum(ws[s:e]) >= {line_dedup.MIN_WORDS}),
gone AS (
  SELECT DISTINCT doc_id, unnest(held) AS i FROM firsts
  WHERE f.d <> doc_id OR s - f.s > e - s),
kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS text
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM real GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.doc_id"""

WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND first <> page_id THEN first END AS refers_to
FROM f"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {W}) AS w FROM documents),
win AS (
  SELECT doc_id, p, w[p:p + {substring.WINDOW - 1}] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS p FROM w)),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {substring.WINDOW})) AS p FROM f WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN r ON w.doc_id = r.doc_id"""

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, bit by bit."""
    code = (f"list_transform(range(1, octet_length(encode({text})) + 1), "
            f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::UBIGINT)")
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {code}), lambda a, b: "
            f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), "
            f"4294967295::UBIGINT)")


SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c, {_crc32("doc_id || ':' || run")} AS h
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run
        FROM documents) GROUP BY doc_id, run),
vocab AS (
  SELECT w AS word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % {spelling.DELETE_EVERY} = 0
                       THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w
        FROM runs)
  WHERE length(w) >= {spelling.MIN_LENGTH} GROUP BY w HAVING sum(c) >= {spelling.MIN_COUNT}),
cuts AS (
  SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut
  FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocab)),
near AS (
  SELECT DISTINCT a.word AS u, b.word AS v FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT word, cut FROM cuts WHERE cut IN (SELECT word FROM vocab)
  UNION SELECT cut, word FROM cuts WHERE cut IN (SELECT word FROM vocab)),
best AS (
  SELECT u, count(*) AS n_near, first(v ORDER BY n DESC, v) AS near, max(n) AS m
  FROM near JOIN vocab ON vocab.word = near.v GROUP BY u),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {spelling.RATIO} * n THEN near END AS form,
         CASE WHEN m >= {spelling.RATIO} * n THEN m END AS form_n
  FROM vocab LEFT JOIN best ON vocab.word = best.u),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL"""

ODDSKETCH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, {W}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {oddsketch.SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {oddsketch.SHINGLE - 2}),
                                      lambda i: array_to_string(w[i:i + {oddsketch.SHINGLE - 1}], ' '))) END AS s
  FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {oddsketch.SIMILARITY} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM sets
  UNION SELECT reach.d, links.v FROM reach JOIN links ON links.u = reach.r),
names AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN names ON sets.doc_id = names.d"""


def _merkle(levels: int) -> str:
    """Trees of up to ``3 ** levels`` leaves, level by level; proofs and folds
    climb with them."""
    field = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (
  SELECT g, i // 3 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d,
         (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY g, i // 3)""")
        return ",\n".join(out)

    def climb(name: str, over: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (
  SELECT p.g, p.r, p.i // 3 AS i, any_value(p.proof) || coalesce(string_agg(s.d, '' ORDER BY s.i), '') AS proof,
         CASE WHEN any_value(t.n) = 1 THEN any_value(p.node)
              ELSE sha256(coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < p.i), '') || any_value(p.node)
                          || coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > p.i), '')) END AS node
  FROM {name}{k} p JOIN {over}{k} t ON p.g = t.g AND p.i = t.i
  LEFT JOIN {over}{k} s ON p.g = s.g AND p.i // 3 = s.i // 3 AND p.i <> s.i GROUP BY p.g, p.r, p.i)""")
        return ",\n".join(out)

    # a group of its own for the null source: the place of a source among all
    return f"""
WITH places AS (
  SELECT source AS src, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
leaves AS (
  SELECT doc_id, g, {leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS shown
  FROM documents JOIN places ON source IS NOT DISTINCT FROM src),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM leaves),
low0 AS (SELECT g, i, leaf AS d, n FROM ranked),
{tree("low")},
top0 AS (SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM low{levels}),
{tree("top")},
path0 AS (SELECT g, i AS r, i, '' AS proof, shown AS node FROM ranked),
{climb("path", "low")},
up0 AS (SELECT 0 AS g, {{'g': g, 'r': r}} AS r, g AS i, proof, node FROM path{levels}),
{climb("up", "top")}
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = t.d AS verified
FROM ranked r JOIN low{levels} s ON s.g = r.g JOIN top{levels} t ON true JOIN up{levels} u ON u.r.g = r.g AND u.r.r = r.i"""


SQL: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_quality_rules": _quality_rules(),
    "op4_warc": WARC,
    "op7_substring_dedup": SUBSTRING,
    "op11_spelling": SPELLING,
    "op12_oddsketch": ODDSKETCH,
    "op13_merkle": _merkle(9),
}
