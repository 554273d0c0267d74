"""SQL for the queries that SQL can express, over the given tables."""

from metaudit.llm.quality_rules import MAX_COVERAGE, MAX_LINE_COVERAGE

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
SMALL = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def windows(name: str, n: int) -> str:
    """Runs of n words per document, from a table w (doc_id, ws)."""
    return (f"{name} AS (SELECT doc_id, s, array_to_string(ws[s:s + {n - 1}], ' ') AS k "
            f"FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS s FROM w WHERE len(ws) >= {n}))")


def covered(n: int) -> str:
    """Words and characters in n-word runs that stand twice or more in their document."""
    return (f"{windows(f'win{n}', n)}, "
            f"in{n} AS (SELECT DISTINCT doc_id, s + o AS i FROM (SELECT doc_id, s, unnest(range({n})) AS o FROM "
            f"(SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win{n}) WHERE c > 1)), "
            f"cov{n} AS (SELECT doc_id, count(*) AS words{n}, sum(length(ws[i])) AS chars{n} "
            f"FROM in{n} JOIN w USING (doc_id) GROUP BY doc_id)")


def quality_rules() -> str:
    lengths = sorted({8, *MAX_COVERAGE})
    joins = " ".join(f"LEFT JOIN cov{n} USING (doc_id)" for n in lengths)
    limits = " AND ".join(f"coalesce(chars{n}, 0)::DOUBLE / greatest(word_chars, 1) <= {most}" for n, most in MAX_COVERAGE.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {WORDS.format(text="text")} AS ws FROM d),
lines AS (SELECT doc_id, l, count(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dup AS (SELECT doc_id, sum(again) AS n_dup_lines,
  sum(again * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS line_chars FROM lines GROUP BY doc_id),
{", ".join(covered(n) for n in lengths)},
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(words8, 0) AS BIGINT) AS n_repeat_words,
  coalesce(line_chars, 0)::DOUBLE / greatest(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 1) AS line_coverage,
  COLUMNS('chars[0-9]+')
  FROM w LEFT JOIN dup USING (doc_id) {joins}),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND line_coverage <= {MAX_LINE_COVERAGE} AND {limits} AS kept FROM judged"""


def jaccard_join() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=SMALL.format(text="coalesce(text, '')"))} AS ws FROM documents),
{windows("win", 5)},
sh AS (SELECT DISTINCT doc_id, k FROM win UNION ALL
  SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
same AS (SELECT ws, count(*) AS c FROM (SELECT doc_id, coalesce(list(k ORDER BY k), []) AS ws
  FROM w LEFT JOIN sh USING (doc_id) GROUP BY doc_id) GROUP BY ws),
sets AS (SELECT doc_id, coalesce(list(k ORDER BY k), []) AS ws FROM w LEFT JOIN sh USING (doc_id) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, CAST(same.c AS BIGINT) AS n_copies
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
JOIN sets USING (doc_id) JOIN same ON same.ws = sets.ws"""


def url_filters(rules) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    host = SMALL.format(text="regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")
    return f"""
WITH r(rhost, rpath, verdict) AS (VALUES {values}),
u AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
  arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)"""


def substring_dedup() -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
{windows("win", 20)},
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM (SELECT doc_id, s, unnest(range(20)) AS o FROM later)),
each AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def fill_in_middle() -> str:
    hashes = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {hashes} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def crc32(text: str) -> str:
    """The checksum of ASCII text, bit by bit (0xEDB88320 reflected)."""
    shift = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(s, x), range(8)), lambda c, i: {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda s, x: {byte}), 4294967295)"


def conversation_trie() -> str:
    words = "len(" + WORDS.format(text="text") + ")"
    return f"""
WITH o AS (SELECT conv_id AS c, turn, sha256(length(role) || ':' || role || text) AS k, {words} AS words FROM
  (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT c, k, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS p FROM o),
m AS (SELECT c, c - c % 20 AS b, {crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT m.c, 0 AS own, p, k, words FROM m JOIN t ON t.c = m.b AND p < h
  UNION ALL SELECT c, 1, p, k, words FROM t JOIN m USING (c) WHERE p >= h),
q AS (SELECT c, k, words, row_number() OVER w AS d, string_agg(k, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY own, p)),
pre AS (SELECT c, d, sha256(path) AS x, words FROM q UNION ALL SELECT c, 0, '', 0 FROM m),
size AS (SELECT c, max(d) AS len FROM pre GROUP BY c),
node AS (SELECT d, x, min(c) AS rep, count(*) AS n, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends
  FROM pre JOIN size USING (c) GROUP BY d, x),
up AS (SELECT n.*, a.rep AS prep, a.d AS pd, a.x AS px FROM node n LEFT JOIN pre p ON p.c = n.rep AND p.d = n.d - 1
  LEFT JOIN node a ON a.d = p.d AND a.x = p.x),
kids AS (SELECT pd AS d, px AS x, count(*) AS kids FROM up WHERE pd IS NOT NULL GROUP BY pd, px),
own AS (SELECT n.rep, n.d, (n.n - 1) * n.words AS worth, CASE WHEN kids IS NULL THEN 1 ELSE 0 END AS leaf FROM node n LEFT JOIN kids USING (d, x)),
sums AS (SELECT p.d, p.x, sum(leaf) AS leaves, sum(worth) AS worth FROM own JOIN pre p ON p.c = own.rep AND p.d <= own.d GROUP BY p.d, p.x)
SELECT CAST(rep AS BIGINT) AS conv_id, CAST(d AS BIGINT) AS depth, CAST(prep AS BIGINT) AS parent_conv_id,
  CAST(n AS BIGINT) AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(s.worth AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM up JOIN sums s USING (d, x) LEFT JOIN kids USING (d, x)"""
