"""The registered queries in DuckDB's SQL. Word lists, patterns of the guard, prompts and the shapes of test views are shared
with the operators; what is computed from them is written out here."""

from __future__ import annotations

from lexquarry.functions import guarding
from lexquarry.operators import answering
from lexquarry.plans import views as V


def _tokens(c: str) -> str:
    return V.TOKENS.format(c)


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


BM25 = f"""tok AS (SELECT doc_id AS id, unnest({_tokens("text")}) AS term FROM documents),
st AS (SELECT count(*) AS n, avg(len({_tokens("text")})) AS avgdl FROM documents),
post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY ALL),
dls AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
OKAPI = f"""{BM25},
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
fixed AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf) ELSE raw END AS idf FROM idf),
asked AS (SELECT item_id AS query_id, unnest({_tokens("text")}) AS term FROM benchmark),
scored AS (SELECT query_id, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) AS bm25
  FROM asked JOIN fixed USING (term) JOIN post USING (term) JOIN dls USING (id), st GROUP BY query_id, id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rn FROM scored) WHERE rn <= 50)"""
DENSE = """pairs AS (SELECT item_id AS query_id, e.vec_id AS id,
    list_sum(list_transform(range(1, 65), lambda k: (q.embedding[k]::DOUBLE - e.embedding[k]::DOUBLE) * (q.embedding[k]::DOUBLE - e.embedding[k]::DOUBLE))) AS distance
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings e),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM pairs) WHERE rn <= 20),
sims AS (SELECT *, CASE WHEN mx <= mn + 1e-12 THEN 1.0 ELSE 1.0 - (distance - mn) / (mx - mn) END AS similarity
  FROM (SELECT *, min(distance) OVER (PARTITION BY query_id) AS mn, max(distance) OVER (PARTITION BY query_id) AS mx FROM near))"""
_NEIGHBOURS = DENSE.replace("SELECT item_id AS query_id,", "SELECT q.vec_id AS query_id,").replace("FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings e)", "FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0)")
FUSED = f"""{OKAPI}, {DENSE},
joined AS (SELECT coalesce(n.query_id, l.query_id) AS query_id, coalesce(n.id, l.id) AS id, bm25, round(distance, 6) AS distance,
    coalesce(1.0::DOUBLE / (60 + n.rn), 0) + coalesce(1.0::DOUBLE / (60 + l.rn), 0) AS score_rrf
  FROM near n FULL OUTER JOIN lex l ON n.query_id = l.query_id AND n.id = l.id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score_rrf DESC, (bm25 IS NOT NULL AND distance IS NOT NULL)::INT DESC, coalesce(-distance, 0.0) DESC, id) AS rank FROM joined) WHERE rank <= 50)"""
POOL = f"""{FUSED},
pool AS (SELECT f.query_id, f.rank, f.id, f.bm25, f.distance, round(f.score_rrf, 8) AS score_rrf, d.text, d.source AS van_ban, {", ".join(V.pool_columns("f.id"))}
  FROM fused f JOIN documents d ON d.doc_id = f.id)"""
SCOPE = "doc_id, nullif(ancestor_dieu_id, ''), CASE WHEN nullif(ancestor_dieu_id, '') IS NULL THEN dieu END"

HEAD = r"""heads AS (SELECT *,
  nullif(regexp_extract(t, '^(?i:chương|CHƯƠNG)\s+([IVXLCDMivxlcdm]+|\d+)(?:[^\pL\pN_]|$)', 1), '') AS chuong,
  CAST(NULL AS VARCHAR) AS muc,
  nullif(regexp_extract(t, '^(?i:điều|ĐIỀU)\s+(\d+)(?:[^\pL\pN_]|$)', 1), '') AS dieu,
  coalesce(nullif(regexp_extract(t, '^(?i:khoản|KHOẢN)\s+(\d+)(?:[^\pL\pN_]|$)', 1), ''), nullif(regexp_extract(t, '^(\d+)[.)]\s+', 1), ''), nullif(regexp_extract(t, '^\((\d+)\)\s+', 1), '')) AS khoan,
  coalesce(nullif(regexp_extract(t, '^(?i:điểm|ĐIỂM)\s+([a-zA-Z])(?:[^\pL\pN_]|$)', 1), ''), nullif(regexp_extract(t, '^([a-z])[.)]\s+', 1), ''), nullif(regexp_extract(t, '^\(([a-z])\)\s+', 1), '')) AS diem,
  CAST(NULL AS VARCHAR) AS phu_luc
  FROM (SELECT *, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM elements))"""
_ORDER = "PARTITION BY doc_id ORDER BY page_number ASC NULLS LAST, i"
_UPTO = f"({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_SINCE = "(PARTITION BY doc_id, {} ORDER BY page_number ASC NULLS LAST, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SECTIONED = f"""{V.ELEMENTS}, {HEAD},
c1 AS (SELECT *, element_type = 'Title' AS is_title, (chuong IS NOT NULL OR dieu IS NOT NULL OR khoan IS NOT NULL OR diem IS NOT NULL) AS has_heading
  FROM heads WHERE t <> '' AND element_type <> 'Footer'),
c2 AS (SELECT *, coalesce(last_value(CASE WHEN NOT is_title THEN 'body' WHEN has_heading THEN 'title' END IGNORE NULLS)
    OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'body', false) AS filled FROM c1),
c3 AS (SELECT *, filled AND has_heading AND (is_title OR dieu IS NOT NULL OR khoan IS NOT NULL OR diem IS NOT NULL) AS flush,
    NOT is_title AND dieu IS NOT NULL AND filled AS forget FROM c2),
c4 AS (SELECT *, sum(flush::INT) OVER {_UPTO} AS section, sum(forget::INT) OVER {_UPTO} AS g_all, sum((dieu IS NOT NULL)::INT) OVER {_UPTO} AS g_article,
    sum((dieu IS NOT NULL OR khoan IS NOT NULL)::INT) OVER {_UPTO} AS g_clause, sum(is_title::INT) OVER {_UPTO} AS titles FROM c3),
rows_ AS (SELECT doc_id, i, source_sha1, element_type, t, text, page_number, is_title, flush, CAST(section AS INT) AS section, titles,
    last_value(chuong IGNORE NULLS) OVER {_SINCE.format("g_all")} AS chuong, muc, last_value(dieu IGNORE NULLS) OVER {_UPTO} AS dieu,
    last_value(khoan IGNORE NULLS) OVER {_SINCE.format("g_article")} AS khoan, last_value(diem IGNORE NULLS) OVER {_SINCE.format("g_clause")} AS diem, phu_luc FROM c4)"""
_KEY = "CASE WHEN dieu IS NULL THEN 'DOC' WHEN khoan IS NULL THEN 'DIEU_' || dieu ELSE 'DIEU_' || dieu || '.KHOAN_' || khoan END"
_LEVEL = "CASE WHEN khoan IS NOT NULL THEN 'khoan' WHEN dieu IS NOT NULL THEN 'dieu' ELSE 'doc' END"
_BITS = "nullif(concat_ws(', ', 'Điều ' || dieu, 'Khoản ' || khoan, 'Điểm ' || diem), '')"
_HEADER = "CASE WHEN h IS NULL THEN title WHEN title = '' THEN h ELSE h || ': ' || title END"
SECTIONS = f"""{SECTIONED},
numbered AS (SELECT *, row_number() OVER ({_ORDER}) AS place FROM rows_),
events AS (SELECT doc_id, place, CASE WHEN NOT is_title THEN section - flush::INT ELSE section - 1 END AS section, titles AS n FROM numbered WHERE (NOT is_title OR flush) AND titles > 0),
took AS (SELECT doc_id, section, arg_min(n, place) AS n FROM events GROUP BY ALL),
names AS (SELECT doc_id, list(t ORDER BY place) AS names FROM numbered WHERE is_title GROUP BY doc_id),
ends AS (SELECT doc_id, max(section) AS final FROM numbered GROUP BY doc_id),
made AS (SELECT doc_id, section, any_value(source_sha1) AS source_sha1, arg_max(coalesce(chuong, ''), place) AS chuong, arg_max(coalesce(dieu, ''), place) AS dieu, arg_max(coalesce(khoan, ''), place) AS khoan,
    arg_max(coalesce(diem, ''), place) AS diem, count(*) FILTER (NOT is_title) AS n_items, min(page_number) FILTER (NOT is_title) AS p1, max(page_number) FILTER (NOT is_title) AS p2 FROM numbered GROUP BY ALL),
kept AS (SELECT m.doc_id, m.section, source_sha1, nullif(chuong, '') AS chuong, nullif(dieu, '') AS dieu, nullif(khoan, '') AS khoan, nullif(diem, '') AS diem, n_items, p1, p2,
    coalesce(array_to_string(list_slice(names, 1, coalesce(n, CASE WHEN m.section = final THEN len(names) END, 0)), ' — '), '') AS title
  FROM made m JOIN ends USING (doc_id) LEFT JOIN took ON took.doc_id = m.doc_id AND took.section = m.section LEFT JOIN names ON names.doc_id = m.doc_id WHERE n_items > 0)"""

_QUESTIONS = V.QUESTIONS_BODY.format("conversations")


def _fixed(c: str) -> str:
    """Spelling fixes in RE2: word ends are letters or digits of any script, kept by groups."""
    out = _strip(c)
    edge = r"(^|[^\pL\pN_])"
    for pattern, right in guarding.FIXES:
        body = pattern.split(")", 1)[1]
        if body.startswith(r"\b"):
            inner = body.removeprefix(r"\b").removesuffix(r"\b")
            # twice, as neighbours share the character between them
            for _ in range(2):
                out = f"regexp_replace({out}, '(?i){edge}{inner}($|[^\\pL\\pN_])', '\\1{right}\\2', 'g')"
        else:
            out = f"regexp_replace({out}, '{body}', '{right}', 'g')"
    return _strip(f"regexp_replace({out}, '\\s+', ' ', 'g')")


_SEGMENTS = f"list_filter(list_transform(string_split_regex(regexp_replace({_fixed('query')}, '([.!;])\\s+', '\\1' || chr(1), 'g'), '[?\\n' || chr(1) || ']+'), lambda s: {_strip('s')}), lambda s: s <> '')"


def _score(c: str) -> str:
    has = lambda w: f"contains(lower({c}), '{w}')::INT"
    return "(" + " + ".join(map(has, guarding.DOMAIN)) + " - " + " - ".join(map(has, guarding.OFF_TOPIC)) + ")"


def _re(pattern: str) -> str:
    return "(?i)" + pattern.split(")", 1)[1].replace(r"\b", "")


_LABEL = f"""CASE WHEN regexp_matches(segment, '{_re(guarding.OVERRIDE)}') OR regexp_matches(segment, '{_re(guarding.ROLE)}') THEN 'injection'
  WHEN regexp_matches(segment, '{_re(guarding.OWNERSHIP)}') AND regexp_matches(segment, '{_re(guarding.SENSITIVE)}') THEN 'sensitive_hijack'
  WHEN {_score("segment")} < 1 THEN 'off_topic' ELSE 'in_domain' END"""
GUARD = f"""q AS ({_QUESTIONS}), cut AS (SELECT query_id, {_SEGMENTS} AS s FROM q),
seg AS (SELECT query_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS segment FROM cut), lab AS (SELECT *, {_LABEL} AS label FROM seg)"""
_PLACE = "CASE label WHEN 'sensitive_hijack' THEN 0 WHEN 'injection' THEN 1 WHEN 'off_topic' THEN 2 ELSE 9 END"
_SHORT = f"CASE WHEN length(segment) > 90 THEN regexp_replace(segment[1:90], '\\s+$', '') || ' ...' ELSE segment END"
_q = lambda s: s.replace("'", "''")
_HINTS = "|".join(map(_q, guarding.HINTS))

_LABELS = "concat(coalesce(w, ''), CASE WHEN w IS NOT NULL AND b IS NOT NULL THEN ' — ' ELSE '' END, coalesce(b, ''), CASE WHEN page_number IS NULL THEN '' ELSE ' | trang ' || page_number END)"
_DATE = """CASE o_orderkey % 6 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN s END"""
_STRIP_TAGS = _strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")
_BR = _strip("regexp_replace(regexp_replace(regexp_replace(html, '(?i)<\\s*br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")
_SENTENCES = f"list_filter(list_transform(string_split_regex(regexp_replace({_strip('text')}, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda s: {_strip('s')}), lambda s: s <> '')"
_MM = lambda c: f"CASE WHEN max({c}) OVER w <= min({c}) OVER w + 1e-12 THEN 1.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"

_KEYED = f"coalesce(nullif(concat_ws('.', 'CHUONG_' || chuong, 'DIEU_' || dieu, 'KHOAN_' || khoan, 'DIEM_' || diem), ''), nullif(regexp_replace({_strip('title')}, '\\s+', '_', 'g')[1:60], ''), 'SECTION')"
_OPENS = "regexp_matches({}, '(?i)^\\s*Điều\\s+\\d+(?:\\s*[,.—–-]\\s*|:?\\s+)')"
_PAGES = "CASE WHEN coalesce({a}, {b}) IS NULL THEN '' WHEN coalesce({a}, {b}) <> coalesce({b}, {a}) THEN ' | trang ' || coalesce({a}, {b}) || '–' || coalesce({b}, {a}) ELSE ' | trang ' || coalesce({a}, {b}) END"


def _packed(most: int, overlap: int) -> str:
    """packed(key, j, chunk) from sentences(key, k, s): one sentence of every text at a time, in a recursion."""
    size, t = 2 * most, "greatest(1, length(p.text) // 2)"
    seed = f"CASE WHEN {overlap} > 0 AND last IS NOT NULL AND greatest(1, length(last) // 2) > {overlap} THEN right(last, {2 * overlap}) END"
    return f"""cut AS (SELECT key, k, s, CASE WHEN greatest(1, length(s) // 2) <= {most} THEN 0 ELSE ceil((length(s) - {size} - 1) / {size}.0)::INT END AS c, greatest(1, length(s) // 2) > {most} AS forced FROM sentences),
each_ AS (SELECT key, k, forced, j, CASE WHEN j < c THEN s[j * {size} + 1:(j + 1) * {size}] ELSE s[j * {size} + 1:] END AS text FROM (SELECT *, unnest(range(c + 1)) AS j FROM cut)),
pieces AS (SELECT key, forced, text, row_number() OVER (PARTITION BY key ORDER BY k, j) AS i FROM each_ WHERE regexp_matches(text, '\\S')),
ends_ AS (SELECT key, max(i) AS n FROM pieces GROUP BY key),
fold(key, i, now, n, last, out) AS (
  SELECT key, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, []::VARCHAR[] FROM ends_
  UNION ALL
  SELECT key, i, CASE WHEN forced THEN NULL WHEN NOT over_ THEN coalesce(now || ' ', '') || text WHEN seed IS NOT NULL AND greatest(1, length(seed) // 2) + t <= {most} THEN seed || ' ' || text ELSE text END,
    CASE WHEN forced THEN 0 WHEN NOT over_ THEN n + t WHEN seed IS NOT NULL AND greatest(1, length(seed) // 2) + t <= {most} THEN greatest(1, length(seed) // 2) + t ELSE t END,
    coalesce(emitted[-1], last), emitted
  FROM (SELECT *, CASE WHEN forced AND over_ THEN list_concat(flushed, [text]) WHEN forced THEN [coalesce(now || ' ', '') || text] WHEN NOT over_ THEN []
      WHEN seed IS NOT NULL AND greatest(1, length(seed) // 2) + t > {most} THEN list_concat(flushed, [seed]) ELSE flushed END AS emitted
    FROM (SELECT *, {seed} AS seed FROM (SELECT f.key, p.i, f.now, f.n, {t} AS t, p.text, p.forced, f.n + {t} > {most} AS over_, CASE WHEN f.now IS NULL THEN []::VARCHAR[] ELSE [f.now] END AS flushed,
      CASE WHEN f.now IS NULL THEN f.last ELSE f.now END AS last FROM fold f JOIN pieces p ON p.key = f.key AND p.i = f.i + 1)))),
emitted_ AS (SELECT key, i, unnest(range(len(out))) AS o, unnest(out) AS chunk FROM fold UNION ALL SELECT f.key, f.i + 1, 0, now FROM fold f JOIN ends_ e ON e.key = f.key AND f.i = e.n WHERE now IS NOT NULL),
stripped_ AS (SELECT key, i, o, {_strip("chunk")} AS chunk FROM emitted_),
packed AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY i, o) - 1)::INT AS j, chunk FROM stripped_ WHERE chunk <> '')"""


def _sentences(c: str) -> str:
    return _SENTENCES.replace("'text'", c).replace("(text,", f"({c},")


_RERANKED = f"""WITH {POOL}, top30 AS (SELECT *, CASE id % 5 WHEN 0 THEN epoch(make_timestamp(2000 + id % 20, 1, id % 28 + 1, 0, 0, 0)) WHEN 1 THEN epoch(make_timestamp(2000 + id % 20, 3, id % 28 + 1, 0, 0, 0)) END AS day FROM pool WHERE rank <= 30),
      f AS (SELECT *, CASE WHEN min(distance) OVER w IS NULL THEN 0.0 WHEN max(distance) OVER w <= min(distance) OVER w + 1e-12 THEN 1.0 WHEN distance IS NULL THEN 0.0 ELSE 1.0 - (distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w) END AS score_vec,
        0.0::DOUBLE AS score_prior_modality, CASE WHEN day IS NULL THEN 0.0 WHEN max(day) OVER w <= min(day) OVER w THEN 1.0 ELSE (day - min(day) OVER w)::DOUBLE / (max(day) OVER w - min(day) OVER w) END AS score_prior_recency,
        least(1.0, count(*) OVER (PARTITION BY query_id, van_ban) / 5.0::DOUBLE) AS score_prior_cohesion, coalesce(bm25, 0.0) AS b0, count(*) OVER (PARTITION BY query_id, {SCOPE}) AS ns, 0.0::DOUBLE AS score_prior_money FROM top30 WINDOW w AS (PARTITION BY query_id)),
      f2 AS (SELECT *, {_MM("b0")} AS score_prior_lexical, ns::DOUBLE / max(ns) OVER w AS score_prior_scope FROM f WINDOW w AS (PARTITION BY query_id)),
      f3 AS (SELECT *, (0.64 + 0.18 * {_MM("score_vec")} + 0.08 + 0.07 * {_MM("score_prior_recency")} + 0.03 * {_MM("score_prior_cohesion")} + 0.06 * {_MM("score_prior_lexical")} + 0.06 * {_MM("score_prior_scope")} + 0.04)
        * CASE WHEN row_number() OVER (PARTITION BY query_id, {SCOPE}, khoan, diem ORDER BY rank) > 1 THEN 0.85 ELSE 1 END AS score_rerank FROM f2 WINDOW w AS (PARTITION BY query_id))"""


CHUNKS = f"""WITH RECURSIVE {SECTIONS},
caps AS (SELECT doc_id, i, [lag(c, 2) OVER w, lag(c, 1) OVER w, lead(c, 1) OVER w, lead(c, 2) OVER w] AS l FROM (SELECT *, {_strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS c FROM elements) WINDOW w AS ({_ORDER})),
shown AS (SELECT doc_id, i, {_strip("array_to_string(list_slice(list_filter(l, lambda t: t IS NOT NULL AND t <> '' AND (length(t) <= 240 OR regexp_matches(t, '(?i)(^|[^\\pL\\pN_])(hình|figure|ảnh|HÌNH|ẢNH)($|[^\\pL\\pN_])'))), 1, 2), ' ')")} AS caption FROM caps),
items AS (SELECT r.doc_id, r.section, r.element_type, r.text, r.t, r.page_number, r.place, CASE WHEN caption <> '' THEN caption ELSE r.t END AS caption FROM numbered r LEFT JOIN shown s ON s.doc_id = r.doc_id AND s.i = r.i WHERE NOT r.is_title),
bodies AS (SELECT doc_id, section, string_agg(text, chr(10) ORDER BY place) FILTER (element_type NOT IN ('Table', 'Image')) AS b, min(page_number) FILTER (element_type NOT IN ('Table', 'Image') AND page_number <> 0) AS q1,
    max(page_number) FILTER (element_type NOT IN ('Table', 'Image') AND page_number <> 0) AS q2 FROM items GROUP BY ALL),
said AS (SELECT k.*, q1, q2, {_strip("coalesce(b, '')")} AS body, {_BITS} AS bits FROM kept k JOIN bodies USING (doc_id, section)),
headed AS (SELECT *, {_KEYED} AS key, {_LEVEL} AS parent_level, {_KEY} AS parent_key, CASE WHEN contains(bits, ', ') THEN regexp_replace(bits, ', ', ' — ') ELSE bits END AS h FROM said),
ready AS (SELECT *, {_HEADER} AS header, sha1(concat_ws('|', source_sha1, parent_level, parent_key))[1:16] AS parent_id,
    concat(doc_id, coalesce(' — ' || nullif(concat_ws(', ', 'Chương ' || chuong, bits), ''), '')) AS named FROM headed),
ready2 AS (SELECT *, CASE WHEN body = '' THEN '' WHEN header = '' OR (dieu IS NOT NULL AND {_OPENS.format("body")}) THEN body ELSE {_strip("header || chr(10) || body")} END AS full_ FROM ready),
parts AS (SELECT doc_id, section, 'TXT' AS kind, 0 AS k, full_ AS payload, NULL AS page FROM ready2 WHERE full_ <> ''
  UNION ALL SELECT doc_id, section, 'TBL', row_number() OVER (PARTITION BY doc_id, section ORDER BY place) - 1, '[BẢNG]' || chr(10) || coalesce(nullif({_strip("replace(text, '[BẢNG]', '')")}, ''), t), page_number FROM items WHERE element_type = 'Table'
  UNION ALL SELECT doc_id, section, 'IMG', row_number() OVER (PARTITION BY doc_id, section ORDER BY place) - 1, '[HÌNH] ' || caption, page_number FROM items WHERE element_type = 'Image' AND caption <> ''),
keyed AS (SELECT *, doc_id || '|' || section || '|' || kind || '|' || k AS key FROM parts),
sentences AS (SELECT key, unnest(range(len(x))) AS k, unnest(x) AS s FROM (SELECT key, {_sentences("payload")} AS x FROM keyed WHERE kind = 'TXT' OR greatest(1, length(payload) // 2) > 520)),
{_packed(520, 80)},
cut_ AS (SELECT y.*, p.j, p.chunk FROM keyed y JOIN packed p ON p.key = y.key UNION ALL SELECT y.*, 0, payload FROM keyed y WHERE kind <> 'TXT' AND greatest(1, length(payload) // 2) <= 520),
child AS (SELECT r.doc_id, sha1(concat_ws('|', source_sha1, r.key || '#' || c.section, kind, CASE WHEN kind = 'TXT' THEN j::VARCHAR ELSE k || '|' || j END))[1:16] AS chunk_id, 'child' AS doc_type,
    CASE kind WHEN 'TXT' THEN 'text' WHEN 'TBL' THEN 'table' ELSE 'image' END AS modality, r.key AS section_key, named || {_PAGES.format(a="q1", b="q2")} AS citation, parent_id,
    {_strip(f"CASE WHEN kind = 'TBL' AND header <> '' AND NOT (dieu IS NOT NULL AND {_OPENS.format('header')}) THEN header || chr(10) ELSE '' END || chunk")} AS text
  FROM cut_ c JOIN ready2 r ON r.doc_id = c.doc_id AND r.section = c.section),
per AS (SELECT doc_id, section, string_agg(payload, chr(10) || chr(10) ORDER BY k) FILTER (kind = 'TBL') AS tables_, '[HÌNH] ' || string_agg(payload[8:], ' ' ORDER BY k) FILTER (kind = 'IMG') AS images_,
    min(page) FILTER (page <> 0) AS g1, max(page) FILTER (page <> 0) AS g2 FROM parts GROUP BY ALL),
up AS (SELECT r.doc_id, r.parent_id, any_value(parent_key) AS parent_key, any_value(dieu) AS dieu, arg_min(CASE WHEN parent_level = 'khoan' THEN khoan END, r.section) AS khoan,
    {_strip("string_agg(concat_ws(chr(10) || chr(10), nullif(full_, ''), tables_, images_), chr(10) || chr(10) ORDER BY r.section)")} AS text, min(least(coalesce(q1, g1), coalesce(g1, q1))) AS a, max(greatest(coalesce(q2, g2), coalesce(g2, q2))) AS z
  FROM ready2 r JOIN per USING (doc_id, section) GROUP BY r.doc_id, r.parent_id),
both_ AS (SELECT * FROM child UNION ALL SELECT doc_id, parent_id, 'parent', 'text', parent_key, concat(doc_id, coalesce(' — ' || nullif(concat_ws(', ', 'Điều ' || dieu, 'Khoản ' || khoan), ''), '')) || {_PAGES.format(a="a", b="z")}, NULL,
  CASE WHEN greatest(1, length(text) // 2) > 8000 THEN text[1:16000] ELSE text END FROM up)"""

VERDICTS = f"""{GUARD}, g AS (SELECT query_id, coalesce(string_agg(segment, ' ' ORDER BY pos) FILTER (label = 'in_domain'), '') AS kept, count(*) FILTER (label <> 'in_domain')::INT AS n_removed,
        list('- (' || label || ') ' || {_SHORT} ORDER BY {_PLACE}, pos) FILTER (label <> 'in_domain') AS removed FROM lab GROUP BY query_id),
      warned AS (SELECT *, CASE WHEN n_removed = 0 THEN '' ELSE '{_q(guarding.WARNING)}' || array_to_string(removed[1:2], chr(10)) || CASE WHEN n_removed > 2 THEN chr(10) || '- ... và ' || (n_removed - 2) || ' phần khác' ELSE '' END END AS user_warning FROM g),
      v AS (SELECT query_id, CASE WHEN kept = '' THEN 'off_topic' ELSE 'ok' END AS status, kept AS normalized_query, CASE WHEN kept = '' THEN 'no_in_domain_after_filter' ELSE 'ok' END AS reason, n_removed, user_warning,
        CASE WHEN kept = '' THEN CASE WHEN user_warning <> '' THEN '{_q(guarding.REMOVED_HINT)}|' ELSE '' END || '{_HINTS}' WHEN user_warning <> '' THEN '{_q(guarding.OK_HINT)}' ELSE '' END AS suggestions FROM warned)"""

ORACLES = {
    "hybrid_search": f"WITH {FUSED} SELECT query_id, rank::INT AS rank, id, bm25, distance, round(score_rrf, 6) AS score_rrf FROM fused WHERE rank <= 12",
    "bm25_okapi_topk": f"WITH {OKAPI} SELECT query_id, id, rn::INT AS rn, bm25 FROM lex",
    "bm25_fts_topk": f"""WITH {BM25}, asked AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens("text")}) AS term FROM benchmark),
      need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY query_id),
      scored AS (SELECT query_id, id, count(*) AS has, round(-sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 8) AS rank FROM asked JOIN df USING (term) JOIN post USING (term) JOIN dls USING (id), st GROUP BY query_id, id)
      SELECT query_id, id, rn::INT AS rn, rank AS fts_rank, -rank AS score_lex
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS rn FROM scored JOIN need USING (query_id) WHERE has = need) WHERE rn <= 50""",
    "knn_l2_topk": f"WITH {_NEIGHBOURS} SELECT query_id, id, rn::INT AS rn, round(distance, 6) AS distance FROM near",
    "distance_similarity": f"WITH {_NEIGHBOURS} SELECT query_id, id, round(similarity, 6) AS similarity FROM sims",
    "rrf_fuse": f"WITH {FUSED} SELECT query_id, rank::INT AS rank, id, round(score_rrf, 6) AS score_rrf FROM fused",
    "hybrid_weighted": f"""WITH {OKAPI}, {DENSE}, l AS (SELECT query_id, id, rn, {_MM("bm25")} AS score_lex FROM lex WINDOW w AS (PARTITION BY query_id)),
      j AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.id, s.id) AS id, 0.45 * coalesce(score_lex, 0) + 0.55 * coalesce(similarity, 0) + coalesce(1.0::DOUBLE / (60 + l.rn), 0) + coalesce(1.0::DOUBLE / (60 + s.rn), 0) AS h
        FROM l FULL OUTER JOIN sims s ON l.query_id = s.query_id AND l.id = s.id)
      SELECT query_id, id, round(h, 6) AS score_hybrid, length(coalesce(text, ''))::INT AS n_chars
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, id) AS rn FROM j) LEFT JOIN documents ON doc_id = id WHERE rn <= 12""",
    "tokenize_counts": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "accent_strip": "SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents",
    "sentence_split": f"SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)",
    "token_truncate": "SELECT doc_id, greatest(1, length(text) // 2)::INT AS n_tokens, CASE WHEN greatest(1, length(text) // 2) <= 520 THEN text ELSE text[1:1040] END AS cut FROM documents",
    "html_strip": f"SELECT page_id, CASE WHEN length(p) > 1200 THEN p[1:1200] || ' ...' ELSE p END AS excerpt, p AS plain, b AS table_text FROM (SELECT page_id, {_STRIP_TAGS} AS p, {_BR} AS b FROM pages)",
    "heading_detect": f"WITH {V.ELEMENTS}, {HEAD} SELECT doc_id, i::INT AS i, chuong, muc, dieu, khoan, diem, phu_luc FROM heads",
    "section_windows": f"WITH {SECTIONED} SELECT doc_id, i::INT AS i, section, flush, chuong, muc, dieu, khoan, diem, phu_luc FROM rows_",
    "section_table": f"""WITH {SECTIONS}, said AS (SELECT *, {_BITS} AS b FROM kept), headed AS (SELECT *, CASE WHEN contains(b, ', ') THEN regexp_replace(b, ', ', ' — ') ELSE b END AS h FROM said)
      SELECT doc_id, section, title, coalesce(nullif(concat_ws('.', 'CHUONG_' || chuong, 'DIEU_' || dieu, 'KHOAN_' || khoan, 'DIEM_' || diem), ''), nullif(regexp_replace({_strip("title")}, '\\s+', '_', 'g')[1:60], ''), 'SECTION') AS section_key,
        {_HEADER} AS header, concat('VB', doc_id, coalesce(' — ' || nullif(concat_ws(', ', 'Chương ' || chuong, b), ''), ''), CASE WHEN p1 IS NULL THEN '' WHEN p1 <> p2 THEN ' | trang ' || p1 || '–' || p2 ELSE ' | trang ' || p1 END) AS citation,
        {_LEVEL} AS parent_level, {_KEY} AS parent_key, sha1(concat_ws('|', source_sha1, {_LEVEL}, {_KEY}))[1:16] AS parent_id, n_items::INT AS n_items FROM headed""",
    "parent_aggregate": f"""WITH {SECTIONED}, p AS (SELECT *, sha1(concat_ws('|', source_sha1, {_LEVEL}, {_KEY}))[1:16] AS parent_id FROM rows_)
      SELECT doc_id, parent_id, min(page_number) AS page_start, max(page_number) AS page_end, count(*) AS n_items, sum(length(text))::BIGINT AS n_chars FROM p GROUP BY doc_id, parent_id""",
    "pack_chunks": f"""WITH RECURSIVE sentences AS (SELECT doc_id AS key, unnest(range(len(x))) AS k, unnest(x) AS s FROM (SELECT doc_id, {_SENTENCES} AS x FROM documents)), {_packed(120, 20)}
      SELECT key AS doc_id, j, chunk AS text FROM packed""",
    "document_chunks": f"{CHUNKS} SELECT doc_id, chunk_id, doc_type, modality, section_key, citation, parent_id, length(text)::INT AS n_chars FROM both_",
    "nearby_caption": f"""WITH {V.ELEMENTS}, e AS (SELECT *, {_strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS c FROM elements),
      n AS (SELECT doc_id, i, [lag(c, 2) OVER w, lag(c, 1) OVER w, lead(c, 1) OVER w, lead(c, 2) OVER w] AS l FROM e WINDOW w AS ({_ORDER}))
      SELECT doc_id, i::INT AS i, array_to_string(list_slice(list_filter(l, lambda t: t IS NOT NULL AND t <> '' AND (length(t) <= 240 OR regexp_matches(t, '(?i)(^|[^\\pL\\pN_])(hình|figure|ảnh|HÌNH|ẢNH)($|[^\\pL\\pN_])'))), 1, 2), ' ') AS caption FROM n""",
    "chunk_ids": f"WITH {V.ELEMENTS} SELECT doc_id, i::INT AS i, sha1(concat_ws('|', source_sha1, 'TXT', i::VARCHAR))[1:16] AS chunk_id, sha1(concat_ws('|', source_sha1, text))[1:16] AS content_id FROM elements",
    "incremental_new": f"WITH {V.ELEMENTS} SELECT doc_id, count(*) AS n_new FROM elements WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id",
    "incremental_counters": "SELECT count(*) AS seen, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS new FROM (SELECT DISTINCT doc_id FROM documents)",
    "dedup_last_wins": f"WITH {V.ELEMENTS} SELECT doc_id, (i % 5)::INT AS k, max(i)::INT AS i, arg_max(text, i) AS text FROM elements GROUP BY doc_id, i % 5",
    "upsert_merge": "SELECT doc_id AS id, source AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'toxic=' || toxic FROM labels",
    "modality": "SELECT doc_id, CASE WHEN doc_id % 7 = 3 OR doc_id % 4 = 0 THEN 'table' WHEN doc_id % 4 IN (1, 2) THEN 'image' ELSE 'text' END AS modality, CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'text' END AS by_text, 'image' AS asked FROM documents",
    "validate_rows": f"WITH {V.ELEMENTS} SELECT CASE WHEN text = '' THEN 'missing text' WHEN i % 9 = 4 THEN 'missing citation' ELSE 'ok' END AS reason, count(*) AS n_rows FROM elements GROUP BY 1",
    "guard_segments": f"WITH {GUARD} SELECT query_id, pos, segment, label FROM lab",
    "guard_verdicts": f"WITH {VERDICTS} SELECT query_id, status, normalized_query, reason, n_removed, user_warning, suggestions FROM v",
    "parent_expand": f"""WITH {POOL}, keyed AS (SELECT *, nullif(ancestor_dieu_id, '') AS ka, CASE WHEN nullif(ancestor_dieu_id, '') IS NULL THEN dieu END AS kd FROM pool),
      strong AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, place) AS gr
        FROM (SELECT query_id, doc_id, ka, kd, round(sum(coalesce(score_rrf, 0) + coalesce(bm25, 0) * 1e-4), 10) AS g, min(rank) AS place FROM keyed GROUP BY ALL)) WHERE gr <= 3),
      store AS (SELECT doc_id AS id, {", ".join(x.replace("AS doc_id", "AS doc") for x in V.pool_columns("doc_id"))} FROM documents),
      sib AS (SELECT query_id, gr, id, row_number() OVER (PARTITION BY query_id, gr ORDER BY id) AS i FROM store JOIN strong s
        ON store.doc = s.doc_id AND ((s.ka IS NOT NULL AND store.ancestor_dieu_id = s.ka) OR (s.ka IS NULL AND store.dieu IS NOT DISTINCT FROM s.kd))),
      fresh AS (SELECT query_id, id, min(gr * 1000 + i) AS o FROM sib WHERE i <= 12 AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = sib.query_id AND p.id = sib.id) GROUP BY ALL),
      placed AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS x FROM fresh)
      SELECT query_id, rank::INT AS rank, id, false AS extra FROM pool UNION ALL
      SELECT query_id, (x + (SELECT max(rank) FROM pool p WHERE p.query_id = placed.query_id))::INT, id, true FROM placed WHERE x <= 36""",
    "rerank_features": f"""{_RERANKED}
      SELECT query_id, id, round(score_vec, 5) AS score_vec, round(score_prior_modality, 5) AS score_prior_modality, round(score_prior_recency, 5) AS score_prior_recency, round(score_prior_cohesion, 5) AS score_prior_cohesion, round(score_prior_lexical, 5) AS score_prior_lexical,
        round(score_prior_scope, 5) AS score_prior_scope, round(score_prior_money, 5) AS score_prior_money, round(score_rerank, 5) AS score_rerank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_rerank DESC, rank) AS fr FROM f3) WHERE fr <= 8""",
    "answer_prompts": f"""{_RERANKED}, best AS (SELECT f.query_id, d.text, concat_ws(' — ', nullif(van_ban, ''), nullif(concat_ws(', ', 'Điều ' || dieu, 'Khoản ' || khoan, 'Điểm ' || diem), '')) AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_rerank DESC, rank) AS fr FROM f3) f JOIN documents d ON d.doc_id = f.id WHERE fr <= 8)
      SELECT query_id, is_table, count(DISTINCT nullif(label, ''))::INT AS n_sources, (any_value(n) + sum(length(coalesce(b.text, '')) + length(label) + length('[1] SOURCE: ' || chr(10) || 'EXCERPT:' || chr(10))) + 2 * (count(*) - 1))::INT AS n_chars
      FROM best b JOIN (SELECT item_id, regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(bảng|bang|table|biểu)($|[^\\pL\\pN_])') AS is_table, length(text) + {len(answering.QUESTION) + 2 + len(answering.CONTEXT) + 2 + len(answering.TASK)} AS n FROM benchmark) q ON q.item_id = b.query_id GROUP BY query_id, is_table""",
    "redundancy": f"WITH {POOL} SELECT query_id, rank::INT AS rank, id, CASE WHEN row_number() OVER (PARTITION BY query_id, {SCOPE}, khoan, diem ORDER BY rank) > 1 THEN 0.85 ELSE 1.0 END::DOUBLE AS penalised FROM pool",
    "recency_prior": """WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 6 < 4 THEN epoch(date_trunc('day', o_orderdate))::BIGINT WHEN o_orderkey % 6 = 5 THEN floor(epoch(o_orderdate))::BIGINT END AS seconds FROM orders)
      SELECT o_orderkey, seconds, round(CASE WHEN seconds IS NULL THEN 0.0 WHEN max(seconds) OVER w <= min(seconds) OVER w THEN 1.0 ELSE (seconds - min(seconds) OVER w)::DOUBLE / (max(seconds) OVER w - min(seconds) OVER w) END, 6) AS recency FROM s WINDOW w AS (PARTITION BY o_custkey)""",
    "money_prior": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS money FROM lineitem",
    "citation_labels": f"""WITH {SECTIONED}, x AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN 'VB' || doc_id END AS w, {_BITS} AS b FROM rows_)
      SELECT doc_id, i::INT AS i, coalesce(nullif({_LABELS}, ''), 'none') AS label FROM x""",
    "unique_sources": "SELECT query_id, string_agg(source, ', ' ORDER BY first) AS sources FROM (SELECT doc_id % 97 AS query_id, source, min(doc_id) AS first FROM documents WHERE source <> '' GROUP BY ALL) GROUP BY query_id",
    "markdown_tables": """WITH b AS (SELECT p_brand, list('| ' || p_name || ' | ' || p_partkey || ' |' ORDER BY p_partkey) AS l FROM part GROUP BY p_brand)
      SELECT p_brand, true AS is_table, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(l, chr(10)) AS block,
        '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(l[1:5], chr(10)) || CASE WHEN len(l) > 5 THEN chr(10) || '... (cắt bớt, còn ' || (len(l) - 5) || ' dòng)' ELSE '' END AS short FROM b""",
    "json_scan": "SELECT count(*) AS n_lines, count(*) FILTER (NOT json_valid(CASE WHEN event_id % 10 = 3 THEN props || '{' ELSE props END)) AS n_bad FROM events WHERE trim(props) <> ''",
}
