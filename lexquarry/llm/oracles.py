"""DuckDB's SQL of the corpus queries that SQL can say, over whole tables.

The others have none: op3 draws at random, op5 solves for its rates, op7 matches with edits, op9 and op10 are trained. Tests
compare those with brute force or held-out labels; what holds of every draw and mix is in the two reports.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CRC = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM documents, crc_table)"""

_LEDGER = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS repeated, 10 * n_symbols > 3 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines,
  word_chars < 2 * n_words AS short, word_chars > 20 * n_words AS long, n_words > 1000000 AS many FROM m)"""

QUALITY = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines::BIGINT AS n_lines, few OR repeated AS base_failed, NOT (few OR repeated OR symbols OR lines OR short OR long OR many) AS kept,
  (few::INT + 2 * repeated::INT + 4 * symbols::INT + 8 * lines::INT + 16 * short::INT + 32 * long::INT + 64 * many::INT)::BIGINT AS failed FROM b"""

ABLATIONS = f"""{_LEDGER},
f AS (SELECT doc_id, unnest([{{'rule': 'few_words', 'f': few}}, {{'rule': 'repeated_words', 'f': repeated}}, {{'rule': 'symbols', 'f': symbols}}, {{'rule': 'repeated_lines', 'f': lines}}, {{'rule': 'short_words', 'f': short}},
  {{'rule': 'long_words', 'f': long}}, {{'rule': 'many_words', 'f': many}}]) AS x FROM b),
p(policy, rule) AS (VALUES ('v1', 'few_words'), ('v1', 'repeated_words'), ('v2', 'few_words'), ('v2', 'repeated_words'), ('v2', 'symbols'), ('v2', 'repeated_lines'), ('v3', 'few_words'), ('v3', 'repeated_words'),
  ('v3', 'symbols'), ('v3', 'repeated_lines'), ('v3', 'short_words'), ('v3', 'long_words'), ('v3', 'many_words')),
of AS (SELECT policy, doc_id, sum(x.f::INT) AS n FROM f JOIN p ON p.rule = x.rule GROUP BY policy, doc_id),
k AS (SELECT policy, count(*) FILTER (n = 0) AS n_kept FROM of GROUP BY policy)
SELECT p.policy, p.rule, count(*) FILTER (x.f)::BIGINT AS n_failed, count(*) FILTER (x.f AND n = 1)::BIGINT AS n_alone, any_value(n_kept)::BIGINT AS n_kept, (any_value(n_kept) + count(*) FILTER (x.f AND n = 1))::BIGINT AS n_kept_without
FROM f JOIN p ON p.rule = x.rule JOIN of ON of.policy = p.policy AND of.doc_id = f.doc_id JOIN k ON k.policy = p.policy GROUP BY p.policy, p.rule"""

_LEVELS = 12  # 13 words doubled up to 26,624; the tables' texts have at most 20,000
_DOUBLED = ",\n".join(f"l{k + 1} AS (SELECT doc_id, i, md5(h || n) AS h FROM (SELECT doc_id, i, h, lead(h, {13 << k}) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l{k}) WHERE n IS NOT NULL)" for k in range(_LEVELS - 1))
_SHARED = " UNION ALL ".join(f"SELECT doc_id, {13 << k} AS l FROM l{k} WHERE h IN (SELECT h FROM l{k} GROUP BY h HAVING count(DISTINCT doc_id) > 1)" for k in range(_LEVELS))
SUBSTRINGS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE doc_id > first),
pos AS (SELECT DISTINCT doc_id, i + k AS p FROM gone, range(13) AS r(k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN pos ON pos.doc_id = words.doc_id AND pos.p = words.p WHERE pos.p IS NULL GROUP BY words.doc_id),
l0 AS (SELECT doc_id, i, md5(s) AS h FROM win),
{_DOUBLED},
far AS (SELECT doc_id, max(l)::BIGINT AS longest FROM ({_SHARED}) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, coalesce(longest, 0) AS longest, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN far ON far.doc_id = w.doc_id"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component AS component_id, component = d.doc_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_D = """d{o} AS (SELECT r, CASE WHEN x > 0 AND x <= 1 THEN x ELSE (r - 0.5::DOUBLE) / r END AS d FROM (SELECT r, CASE WHEN nr > 0 AND n1 > 0 AND 6.0::DOUBLE * n6 / n1 < 1
  THEN ((r + 1)::DOUBLE * ns / (r * nr) - 6.0::DOUBLE * n6 / n1) / (1 - 6.0::DOUBLE * n6 / n1) ELSE -1 END AS x FROM (SELECT r, (SELECT count(*) FROM c{o} WHERE c = r) AS nr, (SELECT count(*) FROM c{o} WHERE c = r + 1) AS ns,
  (SELECT count(*) FROM c{o} WHERE c = 1) AS n1, (SELECT count(*) FROM c{o} WHERE c = 6) AS n6 FROM range(1, 6) AS q(r))))"""
_KATZ = f"""w AS (SELECT doc_id, k, list_append(list_transform(regexp_extract_all({LOWER}, '{WORD}'), lambda x: 'w' || x), 'E') AS w FROM rows),
t AS (SELECT doc_id, k, w[i] AS v, CASE WHEN i = 1 THEN 'S' ELSE w[i - 1] END AS u FROM (SELECT doc_id, k, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
c1 AS (SELECT v, count(*) AS c FROM t WHERE k <> 0 GROUP BY v), c2 AS (SELECT u, v, count(*) AS c FROM t WHERE k <> 0 GROUP BY u, v),
{_D.format(o=1)}, {_D.format(o=2)},
one AS (SELECT v, c, coalesce(d, 1) * c AS seen FROM c1 LEFT JOIN d1 ON r = c),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v, sum(c - seen) AS gap, CASE WHEN sum(c - seen) > 0 THEN 0 ELSE 1 END AS extra FROM one),
p1 AS (SELECT one.v, one.c, seen / (n + extra) AS p FROM one, n),
two AS (SELECT u, v, c, coalesce(d, 1) * c AS seen FROM c2 LEFT JOIN d2 ON r = c),
ctx AS (SELECT u, sum(c)::DOUBLE AS total, sum(c - seen) AS gap, sum(p) AS below FROM (SELECT u, two.v, two.c, seen, p FROM two JOIN p1 ON p1.v = two.v) GROUP BY u),
fit AS (SELECT u, total + e AS total, (gap + e) / (total + e) / (1 - below) AS alpha FROM (SELECT *, CASE WHEN gap < 1e-9 THEN 1 ELSE 0 END AS e FROM ctx)),
s AS (SELECT t.doc_id, t.k, p1.c, log10((coalesce(p1.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1))) AS b,
  log10(CASE WHEN two.seen IS NOT NULL THEN two.seen / fit.total ELSE coalesce(alpha, 1) * coalesce(p1.p, (n.gap + extra) / (n.n + extra)) END) AS p
  FROM t LEFT JOIN p1 ON p1.v = t.v LEFT JOIN two ON two.u = t.u AND two.v = t.v LEFT JOIN fit ON fit.u = t.u, n)
SELECT doc_id, k = 0 AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, (SELECT n FROM n) AS train_tokens, round(sum(b), 6) AS base_score, round(sum(p), 6) AS score FROM s GROUP BY doc_id, k"""
KATZ = f"WITH {CRC},\nrows AS (SELECT doc_id, crc % 10 AS k, text FROM documents JOIN crc USING (doc_id)),\n{_KATZ}"
KATZ_TURNS = f"""WITH rows AS (SELECT doc_id::VARCHAR AS doc_id, 1 AS k, text FROM documents UNION ALL SELECT conv_id || ':' || turn, 0, text FROM conversations),
{_KATZ.replace("GROUP BY doc_id, k", "WHERE k = 0 GROUP BY doc_id, k")}"""

SUFFIXES = """WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
seg AS (SELECT doc_id, s, n, substr(h, 2 * s + 1, 2798) AS p FROM (SELECT *, unnest(range(0, greatest(n - 399, 0), 1000)) AS s FROM d)),
win AS (SELECT doc_id, s + i AS a, md5(substr(p, 2 * i + 1, 800)) AS w FROM (SELECT *, unnest(range(least(1000, n - 399 - s))) AS i FROM seg)),
again AS (SELECT doc_id, a FROM (SELECT doc_id, a, count(*) OVER (PARTITION BY w) AS c FROM win) WHERE c > 1),
cut AS (SELECT doc_id, a, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM (SELECT doc_id, a, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id ORDER BY a) <= 400 THEN 0 ELSE 1 END AS new FROM again)),
runs AS (SELECT doc_id, min(a) AS a, max(a) + 400 AS b FROM cut GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs UNION ALL SELECT d.doc_id, coalesce(max(b), 0), n FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id GROUP BY d.doc_id, n),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS r, count(*) AS c FROM runs GROUP BY doc_id) t ON t.doc_id = d.doc_id"""

SHARDS = """WITH n AS (SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 1) AS size FROM documents)
SELECT s::INT AS shard, n // 8 + (s < n % 8)::INT AS n_rows, 0::BIGINT AS first_slot, n // 8 + (s < n % 8)::INT - 1 AS last_slot, n // 8 + (s < n % 8)::INT AS n_slots, n AS n_docs, size::BIGINT AS all_sizes FROM n, range(8) AS r(s)"""

MIX = f"""WITH RECURSIVE d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, max(size) AS top, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
fill(step, k, held, unit) AS (SELECT 0, k, false, 1.5 * (SELECT sum(total) FROM w) / (SELECT sum(weight) FROM w) FROM w
  UNION ALL SELECT step + 1, k, held, coalesce((1.5 * (SELECT sum(total) FROM w) - sum(CASE WHEN held THEN 2 * total ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN held THEN 0 ELSE weight END) OVER (), 0), 0)
  FROM (SELECT step, f.k, f.held OR f.unit * weight > 2 * total AS held, total, weight FROM fill f JOIN w ON w.k = f.k WHERE step <= (SELECT count(*) FROM w))),
last AS (SELECT k, held, unit FROM fill WHERE step = (SELECT max(step) FROM fill))
SELECT source, total AS source_size, round(CASE WHEN held THEN 2.0 * total ELSE unit * weight END, 4) AS target, true AS near, true AS within FROM w JOIN last ON last.k = w.k"""

TRIE = f"""WITH {CRC.split("crc AS")[0]}
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS r, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT c, c - c % 100 AS base FROM t),
h AS (SELECT c, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h FROM c, crc_table),
b AS (SELECT h.c, 0 AS own, r, role, text FROM h JOIN t ON t.c = h.base AND r < h UNION ALL SELECT h.c, 1, r, role, text FROM h JOIN t ON t.c = h.c AND r >= h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, r) AS d, length(text) AS n, md5(length(role) || ':' || role || text) AS k FROM b),
p AS (SELECT c, d, n, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM o UNION ALL SELECT c, 0, 0, 'root' FROM c),
q AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS top FROM p),
v AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, any_value(n) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = top) AS ends FROM q GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (d, k)),
s AS (SELECT a.d, a.k, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved_tokens FROM x JOIN p a ON a.c = x.c AND a.d <= x.d GROUP BY ALL)
SELECT x.c AS conv_id, x.d AS depth, u.c AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN s USING (d, k) LEFT JOIN v u ON u.d = x.d - 1 AND u.k = x.up"""

SECRETS = r"""WITH c AS (SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents)
SELECT n_assign::BIGINT AS n_assign, n_access::BIGINT AS n_access, n_hex::BIGINT AS n_hex, count(*) AS n_docs, sum(doc_id)::BIGINT AS ids FROM c GROUP BY 1, 2, 3"""

ORACLES = {"secrets_report": SECRETS, "op11_prefix_trie": TRIE, "op2_suffix_dedup": SUFFIXES, "sharding_report": SHARDS, "mixing_report": MIX, "op1_katz": KATZ, "katz_conversations": KATZ_TURNS, "op4_quality": QUALITY, "quality_ablations": ABLATIONS, "op6_substring_dedup": SUBSTRINGS, "op8_near_dedup": NEAR}
