"""DuckDB SQL for the registered queries: the same results from the tables alone."""

from __future__ import annotations

from fascicle.functions.filters import SECTIONS
from fascicle.functions.text import STOPWORDS, TOKEN
from fascicle.operators import curation, layout
from fascicle.plans.queries import EXPRESSIONS, QUESTION, TOPICS

_NAMES = "[" + ", ".join(f"'{s}'" for s in SECTIONS) + "]"
_CURATED = "[" + ", ".join(f"'{s}'" for s in curation.SECTIONS) + "]"
_TOKEN = TOKEN.removeprefix("(?i)")

_CHUNKS = f"""
chunks AS (SELECT doc_id AS chunk_id, text AS page_content, substr(source || ' ' || lang, 1, 350) AS heading, CAST(DATE '2026-01-01' + CAST(doc_id % 31 AS INTEGER) AS VARCHAR) AS date,
  CAST(20260101 + doc_id % 31 AS INTEGER) AS "dateInt", CAST(doc_id % 16 + 1 AS INTEGER) AS "pageNumber", ({_NAMES})[CAST(doc_id % 16 AS INTEGER) + 1] AS section FROM documents)"""


def _tokens(text: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({text}, '{_TOKEN}', 0, 'i'), lambda x: regexp_replace(lower(x), '₹|\brs\.?|\binr\b|\$|\s+', '', 'g')), lambda x: x <> '')"


_INDEX = f"""{_CHUNKS},
toks AS (SELECT chunk_id, {_tokens(r"heading || chr(10) || heading || chr(10) || regexp_replace(page_content, '^\s+|\s+$', '', 'g')")} AS t FROM chunks),
lens AS (SELECT chunk_id, len(t) AS length FROM toks),
stats AS (SELECT count(*) AS n, avg(greatest(length, 1)) AS avg_length FROM lens),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS token FROM toks) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
rare AS (SELECT token, df FROM dfs, stats WHERE df < 0.01::DOUBLE * greatest(n, 1)),
postings AS (SELECT token, chunk_id, tf, df, length FROM tf JOIN rare USING (token) JOIN lens USING (chunk_id))"""

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _asked(rows) -> str:
    values = ", ".join(f"({i}, '{s}')" for i, s in rows)
    return f"""
asked AS (SELECT topic_id, list_filter({_tokens('search')}, lambda x: NOT list_contains({_STOP}, x)) AS raw FROM (VALUES {values}) AS v(topic_id, search)),
base AS (SELECT topic_id, CASE WHEN len(list_filter(raw, lambda x: NOT regexp_matches(x, '^(?:19|20)\\d{{2}}$'))) > 0 THEN list_filter(raw, lambda x: NOT regexp_matches(x, '^(?:19|20)\\d{{2}}$')) ELSE raw END AS words FROM asked),
content AS (SELECT topic_id, token, min(ord) AS ord FROM (SELECT topic_id, unnest(words) AS token, generate_subscripts(words, 1) AS ord FROM base) GROUP BY ALL),
lexical AS (SELECT topic_id, token FROM content UNION SELECT topic_id, token || 's' FROM content WHERE length(token) > 3 AND NOT ends_with(token, 's') AND NOT regexp_matches(token, '^(?:19|20)\\d{{2}}$') AND NOT regexp_matches(token, '^\\d{{1,3}}(?:,\\d{{2,3}})+(?:\\.\\d+)?%?$|^\\d+(?:\\.\\d+)?%$'))"""


def _bm25(k: int, only_open: bool = False) -> str:
    gate = "AND topic_id IN (SELECT topic_id FROM weights WHERE open)" if only_open else ""
    return f"""
scored AS (SELECT topic_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * greatest(length, 1) / greatest(avg_length, 1)))) AS bm25 FROM postings JOIN lexical USING (token), stats WHERE TRUE {gate} GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scored WHERE bm25 > 0) WHERE rank <= {k})"""


_WEIGHTS = """
gated AS (SELECT topic_id, token, ord, df FROM content JOIN rare USING (token)),
weights AS (SELECT v.topic_id, r.df IS NOT NULL AS open, CASE WHEN r.df IS NULL THEN 0.75::DOUBLE WHEN r.df <= 3 OR 0.01::DOUBLE * n <= 3 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE + 0.5::DOUBLE * (1 - exp(-8 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (r.df - 3) / (0.01::DOUBLE * n - 3))))) / (1 - exp(-8::DOUBLE)) END AS w_sem
  FROM asked AS v LEFT JOIN (SELECT topic_id, min(df) AS df FROM gated GROUP BY topic_id) AS r USING (topic_id), stats)"""


def _hybrid(rows, k: int) -> str:
    return f"""{_INDEX}, {_asked(rows)}, {_WEIGHTS}, {_bm25(20, True)},
cos AS (SELECT q.vec_id AS topic_id, v.vec_id AS chunk_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cosine FROM embeddings AS v, embeddings AS q WHERE q.vec_id < {len(rows)}),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY cosine DESC, chunk_id) AS rank FROM cos) WHERE rank <= 20),
one AS (SELECT coalesce(s.topic_id, l.topic_id) AS topic_id, coalesce(s.chunk_id, l.chunk_id) AS chunk_id, s.rank AS sem_rank, l.rank AS lex_rank FROM sem AS s FULL JOIN lex AS l ON s.topic_id = l.topic_id AND s.chunk_id = l.chunk_id),
summed AS (SELECT one.*, coalesce(w_sem / (10 + sem_rank), 0) + coalesce((1 - w_sem) / (10 + lex_rank), 0) AS score FROM one JOIN weights USING (topic_id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, sem_rank NULLS LAST, lex_rank NULLS LAST, chunk_id) AS rank FROM summed) WHERE rank <= {k}),
merged AS (SELECT chunk_id, topic_id, row_number() OVER (ORDER BY topic_id, rank) AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY topic_id, rank) AS first FROM fused) WHERE first = 1)"""


_ARTICLES = f"""
articles AS (SELECT doc_id AS id, CAST(doc_id % 16 + 1 AS INTEGER) AS "pageNumber", lang || ' article ' || doc_id AS title, ({_CURATED})[CAST(doc_id % 9 AS INTEGER) + 1] AS section, CASE q.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS "examRelevance",
  text AS summary, [lang, source] AS tags, 1767225600 + (doc_id * 7919) % 86400 AS created FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) AS q USING (doc_id))"""

_PROGRESS = """
days AS (SELECT CAST(DATE '2026-01-01' + CAST(2 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS DATE) AS date, count(*) AS n, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error,
  count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1),
found AS (SELECT date, n FROM days),
old AS (SELECT date, n, CASE WHEN click > view THEN n ELSE 1 END AS size, CASE WHEN purchase > view THEN 'complete' ELSE 'in_progress' END AS status FROM days WHERE error > signup),
spine AS (SELECT CAST(unnest(generate_series(DATE '2026-01-01', (SELECT greatest(DATE '2026-02-10', max(date)) FROM found), INTERVAL 1 DAY)) AS DATE) AS date),
progress AS (SELECT s.date, f.n AS size, CASE WHEN f.n IS NULL THEN 'missing' WHEN o.status IS NULL THEN 'pending' WHEN o.size = f.n THEN o.status ELSE 'stale' END AS status,
  CASE WHEN f.n IS NOT NULL THEN CASE WHEN o.size = f.n THEN 4 ELSE 1 END END AS next_page, CASE WHEN f.n IS NOT NULL THEN CASE WHEN o.size = f.n THEN 7 ELSE 0 END END AS "vectorCount", CASE WHEN o.size = f.n THEN 16 END AS "totalPages"
  FROM spine AS s LEFT JOIN found AS f USING (date) LEFT JOIN old AS o USING (date))"""


def _section_case(raw: str, otherwise: str = "'National'") -> str:
    key = rf"trim(regexp_replace(lower({raw}), '[\s_-]+', ' ', 'g'))"
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{name}'" for a, name in curation.ALIASES) + f" ELSE {otherwise} END"


_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_clip = lambda t, n: f"CASE WHEN length({t}) > {n} THEN trim(substr({t}, 1, {n})) || '…' ELSE {t} END"
_SENTENCES = "list_filter(list_transform(regexp_extract_all(" + _COLLAPSE.format("page_content") + """, '[^.!?]+(?:[.!?]+(?:["”'']+)?\\s*|$)'), lambda x: trim(x)), lambda x: x <> '')"""


_CURATION = rf"""
p AS (SELECT *, regexp_replace(array_to_string(list_slice(string_split(page_content, ' '), 1, 3), ' '), '^\s+|\s+$', '', 'g') AS h FROM chunks),
e AS (SELECT *, CASE WHEN h <> '' AND instr(page_content, h) > 0 THEN substr(page_content, 1, instr(page_content, h) - 1) || substr(page_content, instr(page_content, h) + length(h)) ELSE page_content END AS body FROM p),
prepared AS (SELECT * FROM e WHERE h <> '' AND NOT regexp_matches(h, '^page\s*\d+\s+other text$', 'i') AND NOT regexp_matches(h, '^letters?\s+to\s+the\s+editor$', 'i') AND length({_COLLAPSE.format("body")}) >= 50),
v AS (SELECT prepared.*, CASE chunk_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'none' ELSE 'odd' END AS rel, regexp_replace(page_content, '^\s+|\s+$', '', 'g') AS refined FROM prepared JOIN labels ON doc_id = chunk_id WHERE quality = 1),
kept AS (SELECT heading AS source, "pageNumber", substr(h, 1, 240) AS title, 'Op-Ed' AS section, CASE WHEN rel = 'high' THEN 'high' ELSE 'medium' END AS "examRelevance", 'a' AS tags, refined FROM v WHERE rel <> 'none' AND NOT (rel = 'low' AND length(refined) < 200) AND length(refined) >= 80)"""


def _pack_sentences(most: int, again: int) -> str:
    """The packing of sentences as a fold: one step of the recursion takes each text's next sentence."""
    size = lambda x: f"len(string_split({x}, ' '))"
    words = lambda held: f"coalesce(list_sum(list_transform({held}, lambda y: {size('y')})), 0)"
    ended = lambda x: f"""regexp_matches({x}, '[.!?]["”'']?$')"""
    suffix = lambda held, k: f"list_slice({held}, len({held}) - {k} + 1, len({held}))"
    take = lambda held: suffix(held, f"(1 + len(list_filter(range(1, len({held})), lambda k: {words(suffix(held, 'k'))} < {again})))")
    none = "CAST([] AS VARCHAR[])"
    return f"""
sent AS (SELECT chunk_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT chunk_id, CASE WHEN len(s) = 0 AND flat <> '' THEN [flat] ELSE s END AS s FROM (SELECT chunk_id, {_SENTENCES} AS s, {_COLLAPSE.format("page_content")} AS flat FROM chunks))),
sums AS (SELECT chunk_id, sum({size("s")}) AS total, max(i) AS n, string_agg(s, ' ' ORDER BY i) AS whole FROM sent GROUP BY chunk_id),
fold AS (SELECT chunk_id, CAST(0 AS BIGINT) AS i, n, {none} AS held, {none} AS made FROM sums WHERE total > {most}
  UNION ALL SELECT chunk_id, i + 1, n, CASE WHEN alone THEN CASE WHEN {ended("s")} THEN [s] ELSE {none} END WHEN spill THEN CASE WHEN {words("kept")} + {size("s")} > {most} THEN {none} ELSE kept END || [s] ELSE held || [s] END,
    CASE WHEN alone THEN made || [s] WHEN spill THEN made || [array_to_string(list_slice(held, 1, stop), ' ')] ELSE made END
  FROM (SELECT *, {take("source")} || list_slice(held, stop + 1, len(held)) AS kept
    FROM (SELECT *, CASE WHEN len(list_filter(list_slice(held, 1, stop), lambda y: {ended("y")})) > 0 THEN list_filter(list_slice(held, 1, stop), lambda y: {ended("y")}) ELSE list_slice(held, 1, stop) END AS source
      FROM (SELECT f.*, t.s, len(held) = 0 AND {size("t.s")} > {most} AS alone, len(held) > 0 AND {words("held")} + {size("t.s")} > {most} AS spill,
          coalesce(list_max(list_filter(range(2, len(held) + 1), lambda k: {ended("held[k]")})), 1) AS stop FROM fold AS f JOIN sent AS t ON t.chunk_id = f.chunk_id AND t.i = f.i + 1)))),
packed AS (SELECT chunk_id, [whole] AS pieces FROM sums WHERE total <= {most}
  UNION ALL SELECT chunk_id, CASE WHEN len(held) > 0 AND (len(made) = 0 OR array_to_string(held, ' ') <> made[-1]) THEN made || [array_to_string(held, ' ')] ELSE made END FROM fold WHERE i = n)"""


#: Lines of the test pages: each item is a line of its own, as rows lie 24 points apart.
_PAGE_LINES = r"""
runs AS (SELECT page_id, unnest(r) AS run, generate_subscripts(r, 1) - 1 AS item FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<(?:h[1-3]|p|li)[^>]*>[^<]{3,}') AS r FROM pages)),
items AS (SELECT page_id, item, regexp_replace(regexp_replace(regexp_replace(run, '^<[^>]*>', ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text, CASE WHEN regexp_matches(run, '^<h', 'i') THEN 18.0::DOUBLE ELSE 9.0::DOUBLE END AS size FROM runs),
own AS (SELECT *, 40 + size * length(text) * 0.42::DOUBLE AS x1, row_number() OVER (PARTITION BY page_id ORDER BY item) - 1 AS line_no FROM items
  WHERE text <> '' AND NOT regexp_matches(text, '^saturday,|^https?://|^vol\.|^\s*([incmyk]\s*)+$|^\d{1,3}$', 'i') AND NOT starts_with(lower(text), 'www.')),
centres AS (SELECT page_id, list_sort(list((40 + x1) / 2) FILTER (size BETWEEN 7.5 AND 11)) AS c FROM own GROUP BY page_id),
cuts AS (SELECT page_id, CASE WHEN coalesce(len(c), 0) < 30 THEN [] ELSE list_filter(list_transform(range(1, len(c)), lambda k: CASE WHEN c[k + 1] - c[k] >= 45 THEN (c[k] + c[k + 1]) / 2 END), lambda v: v IS NOT NULL) END AS cut FROM centres),
edges AS (SELECT page_id, [0.0::DOUBLE] || CAST(cut AS DOUBLE[]) || [601.0::DOUBLE] AS e FROM cuts),
spans AS (SELECT page_id, list_filter(list_transform(range(1, len(e)), lambda k: [e[k], e[k + 1]]), lambda v: v[2] - v[1] > 50) AS spans FROM edges),
lines AS (SELECT own.*, coalesce(list_position(list_transform(spans, lambda v: (40 + x1) / 2 >= v[1] AND (40 + x1) / 2 < v[2]), true), len(spans)) - 1 AS col FROM own JOIN spans USING (page_id))"""


def _layout(page: str = "page_id + 1") -> str:
    """Articles of the test pages. All lines there start at one edge, 24 points apart, so neighbouring
    headings are one, and a body line belongs to the nearest heading above it."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    structural = "|".join(layout.STRUCTURAL).replace("'", "''")
    kept = r"regexp_replace(regexp_replace(k.text, '[^A-Za-z\s''’]', '', 'g'), '^\s+|\s+$', '', 'g')"
    letters = rf"regexp_replace({kept}, '\s', '', 'g')"
    return rf"""{_PAGE_LINES},
kinds AS (SELECT page_id, item, text, size, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key, len(string_split(text, ' ')) AS n FROM own),
marked AS (SELECT *, size = 18 AND key NOT IN ({quoted([*SECTIONS, *layout.BLOCKED])}) AND NOT regexp_matches(text, '{"|".join(layout.POINTERS)}', 'i') AND NOT (n <= 8 AND regexp_matches(text, '^[A-Za-z]{{2,}}\.\s+[A-Z]')) AND NOT (n <= 4 AND regexp_matches(text, 'page\s+\d+', 'i')) AS head FROM kinds),
heads AS (SELECT page_id, min(item) AS top, string_agg(text, ' ' ORDER BY item) AS title FROM (SELECT *, item - row_number() OVER (PARTITION BY page_id ORDER BY item) AS island FROM marked WHERE head) GROUP BY page_id, island),
kickers AS (SELECT k.page_id, k.item, k.text FROM heads AS h JOIN marked AS k ON k.page_id = h.page_id AND k.item = h.top - 1 AND NOT k.head AND k.size = 9
  WHERE length({kept}) <= 28 AND length({letters}) >= 3 AND length(regexp_replace({letters}, '[^A-Z]', '', 'g')) >= 0.85::DOUBLE * length({letters})),
body AS (SELECT m.page_id, m.item, m.text FROM marked AS m ANTI JOIN kickers AS k ON k.page_id = m.page_id AND k.item = m.item WHERE NOT head AND NOT regexp_matches(text, '{structural}', 'i') AND NOT (size = 18 AND key IN ({quoted(SECTIONS)}))),
owned AS (SELECT b.page_id, coalesce(h.top, -1) AS top, b.item, b.text, lead(b.text) OVER (PARTITION BY b.page_id, coalesce(h.top, -1) ORDER BY b.item) AS next FROM body AS b ASOF LEFT JOIN heads AS h ON h.page_id = b.page_id AND h.top <= b.item),
texts AS (SELECT page_id, top, string_agg(CASE WHEN ends_with(text, '-') AND regexp_matches(next, '^[a-zA-Z]') THEN left(text, -1) WHEN next IS NULL THEN text ELSE text || ' ' END, '' ORDER BY item) AS body FROM owned GROUP BY ALL),
titled AS (SELECT h.page_id, h.top, coalesce(k.text || ': ', '') || title AS title FROM heads AS h LEFT JOIN kickers AS k ON k.page_id = h.page_id AND k.item = h.top - 1
  UNION ALL SELECT page_id, -1, 'Page ' || ({page}) || ' other text' FROM texts WHERE top = -1),
tidy AS (SELECT page_id, top, {_COLLAPSE.format(r"regexp_replace(" + _COLLAPSE.format(r"regexp_replace(title, '\b\d{5,}\b', ' ', 'g')").replace("trim(", "(") + r", '([''’])\s+[a-z][a-z''-]*\.\s+[A-Z].*$', '\1', 'g')")} AS heading FROM titled),
articles AS (SELECT page_id, top, heading, coalesce(body, '') AS body FROM tidy LEFT JOIN texts USING (page_id, top) WHERE heading <> '' AND (length(heading) + CASE WHEN coalesce(body, '') <> '' THEN 2 + length(body) ELSE 0 END >= 16 OR len(string_split(heading, ' ')) >= 3))"""


def oracle_sql() -> dict[str, str]:
    flat = _COLLAPSE.format("page_content")
    return {
        "q01_tokenize_tf": f"WITH {_INDEX} SELECT token, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY token",
        "q02_filter_eq_in_range": f"""WITH {_CHUNKS} SELECT chunk_id, date, "pageNumber", section FROM chunks WHERE (date = '2026-01-05' AND section IN ('news', 'World', 'states', 'sport')) OR ("dateInt" >= 20260110 AND "dateInt" < 20260112 AND "pageNumber" > 3 AND "pageNumber" <= 9)""",
        "q03_date_parts": f"""WITH {_CHUNKS}, r AS (SELECT chunk_id, try_cast(CASE WHEN chunk_id % 10 = 0 THEN '2026-02-30' ELSE date END AS DATE) AS d FROM chunks)
            SELECT chunk_id, d IS NOT NULL AS valid, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS date_int, CAST(CAST(d + INTERVAL 3 DAY AS DATE) AS VARCHAR) AS plus3 FROM r""",
        "q04_layout_order": f"""WITH {_CHUNKS} SELECT chunk_id, "dateInt", "pageNumber", heading, row_number() OVER (ORDER BY "dateInt", "pageNumber", heading, chunk_id) - 1 AS position FROM chunks""",
        "q05_filtered_get": f"""WITH {_CHUNKS} SELECT chunk_id, "dateInt", "pageNumber", heading FROM chunks WHERE "pageNumber" = 7 AND "dateInt" <= 20260120""",
        "q06_inverted_index": f"WITH {_INDEX} SELECT token, chunk_id, tf, df FROM postings",
        "q07_rare_tokens": f"WITH {_INDEX} SELECT token, df FROM rare",
        "q08_bm25_topk": f"WITH {_INDEX}, {_asked([(0, QUESTION)])}, {_bm25(10)} SELECT chunk_id, round(bm25, 6) AS bm25, rank FROM lex",
        "q09_gate": f"""WITH {_INDEX}, {_asked(TOPICS)} SELECT topic_id, token, coalesce(df, 0) AS df, n, CASE WHEN coalesce(df, 0) = 0 THEN 'no-match' WHEN df < 0.01::DOUBLE * n THEN 'selected' ELSE 'common' END AS status FROM content LEFT JOIN dfs USING (token), stats""",
        "q10_cosine_topk": """SELECT v.vec_id AS chunk_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cosine FROM embeddings AS v, embeddings AS q WHERE q.vec_id = 0 AND v.label IN (0, 1, 2, 3, 4) ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 20""",
        "q11_fusion_weights": """WITH g AS (SELECT CASE WHEN i < 40 THEN i END AS df, (SELECT count(*) FROM documents) AS n FROM range(41) AS r(i)),
            w AS (SELECT df, CASE WHEN df IS NULL THEN 0.75::DOUBLE WHEN df <= 3 OR 0.01::DOUBLE * n <= 3 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE + 0.5::DOUBLE * (1 - exp(-8 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (df - 3) / (0.01::DOUBLE * n - 3))))) / (1 - exp(-8::DOUBLE)) END AS s FROM g)
            SELECT df, round(s, 6) AS w_sem, round(1 - s, 6) AS w_lex FROM w""",
        "q12_hybrid_rrf": f"WITH {_hybrid([(0, QUESTION)], 10)} SELECT chunk_id, round(score, 6) AS score, sem_rank, lex_rank, rank FROM fused",
        "q13_multi_topic_dedupe": f"WITH {_hybrid(TOPICS, 5)} SELECT chunk_id, CAST(topic_id AS INTEGER) AS topic_id, ordinal FROM merged",
        "q14_late_materialise": f"""WITH {_hybrid(TOPICS, 5)} SELECT m.chunk_id, ordinal, "pageNumber", coalesce(length(page_content), 0) AS n_chars FROM merged AS m LEFT JOIN chunks USING (chunk_id)""",
        "q16_sentence_counts": f"""WITH {_CHUNKS}, s AS (SELECT chunk_id, page_content, {_SENTENCES} AS s FROM chunks) SELECT chunk_id, CAST(CASE WHEN len(s) = 0 AND {flat} <> '' THEN 1 ELSE len(s) END AS BIGINT) AS n_sentences, regexp_matches(regexp_replace(page_content, '^\\s+|\\s+$', '', 'g'), '[.!?]["”'']?\\s*$') AS complete FROM s""",
        "q17_chunk_roundtrip": rf"""WITH {_CHUNKS}, b AS (SELECT *, regexp_replace(page_content, '^\s+|\s+$', '', 'g') AS t FROM chunks), c AS (SELECT *, {_COLLAPSE.format("CASE WHEN t = heading THEN '' WHEN starts_with(t, heading || ' ') OR starts_with(t, heading || chr(10)) THEN substr(t, length(heading) + 1) ELSE t END")} AS f FROM b)
            SELECT chunk_id, heading, CAST("pageNumber" AS BIGINT) AS chunk_index, CAST("pageNumber" + 2 AS BIGINT) AS chunk_total, CASE WHEN length(f) <= 220 THEN f ELSE trim(substr(f, 1, 220)) || '…' END AS excerpt FROM c""",
        "q18_word_count": f"WITH {_CHUNKS} SELECT chunk_id, CAST(len(list_filter(string_split({flat}, ' '), lambda x: x <> '')) AS BIGINT) AS n_words FROM chunks",
        "q19_section_counts": f"WITH {_ARTICLES} SELECT section, count(*) AS count FROM articles GROUP BY section",
        "q20_article_page": f"""WITH {_ARTICLES}, found AS (SELECT * FROM articles WHERE regexp_matches(title, '^[a-m][^\\n]*th|src2$', 'i') OR regexp_matches(summary, '^[a-m][^\\n]*th|src2$', 'i') OR len(list_filter(tags, lambda x: regexp_matches(x, '^[a-m][^\\n]*th|src2$', 'i'))) > 0)
            SELECT id, section, "examRelevance", "pageNumber", created, ordinal, total FROM (SELECT *, row_number() OVER (ORDER BY "examRelevance" DESC, "pageNumber", created DESC, id) - 1 AS ordinal, count(*) OVER () AS total FROM found) WHERE ordinal BETWEEN 5 AND 24""",
        "q21_sessions": rf"""WITH m AS (SELECT conv_id, role, text, turn FROM conversations WHERE role <> 'system'), t AS (SELECT conv_id, {_COLLAPSE.format("coalesce(arg_min(text, turn) FILTER (role = 'user'), '')")} AS q, {_COLLAPSE.format("arg_max(text, turn)")} AS p, count(*) AS n, max(turn) AS last FROM m GROUP BY conv_id)
            SELECT conv_id AS "sessionId", 'u' || (conv_id % 7) AS "userId", CASE WHEN q = '' THEN 'New chat' WHEN length(q) > 60 THEN substr(q, 1, 57) || '…' ELSE q END AS title, CAST(least(length(p), 200) AS BIGINT) AS preview_chars, n AS "messageCount", 1767225600 + conv_id * 3600 + last * 60 AS last_at FROM t""",
        "q22_last_summary": """WITH m AS (SELECT conv_id AS s, text AS summary, ((conv_id * 1000 + turn) * 7) % 11 AS c FROM conversations WHERE role = 'assistant') SELECT s AS "sessionId", substr(summary, 1, 2000) AS summary, c AS "summaryAtCount" FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c DESC, summary DESC) AS r FROM m) WHERE r = 1""",
        "q23_log_search": """SELECT event_id AS id, event_type AS level, 'u' || user_id AS source, event_type || ' ' || props AS message, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS ordinal FROM events WHERE event_type = 'error' AND regexp_matches(event_type || ' ' || props, '"k": 1', 'i') ORDER BY ordinal LIMIT 50""",
        "q24_log_counts": "SELECT event_type AS level, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1",
        "q25_normalize_section": f"WITH {_CHUNKS}, r AS (SELECT CASE chunk_id % 5 WHEN 0 THEN 'Op_Ed' WHEN 1 THEN upper(section) ELSE ' ' || section END AS raw FROM chunks) SELECT {_section_case('raw')} AS section, count(*) AS n FROM r GROUP BY 1",
        "q26_curation_gate": rf"""WITH {_CHUNKS}, {_CURATION} SELECT source, "pageNumber", title, section, "examRelevance", tags, least(length(refined), 800) AS summary_chars, CAST(len(list_filter(string_split({_COLLAPSE.format("refined")}, ' '), lambda x: x <> '')) AS BIGINT) AS "wordCount", sha256(refined) AS body FROM kept""",
        "q27_calendar_spine": f'WITH {_PROGRESS} SELECT CAST(date AS VARCHAR) AS date, status, CAST(next_page AS BIGINT) AS next_page, CAST("vectorCount" AS BIGINT) AS "vectorCount" FROM progress',
        "q28_status_counts": f"WITH {_PROGRESS} SELECT s AS status, count(date) AS count FROM (SELECT unnest(['missing', 'pending', 'in_progress', 'complete', 'stale']) AS s) LEFT JOIN progress ON s = status GROUP BY s",
        "q29_file_batch": f"WITH {_PROGRESS} SELECT CAST(date AS VARCHAR) AS date, status, row_number() OVER (ORDER BY date) AS ordinal FROM (SELECT date, status FROM progress WHERE status IN ('pending', 'in_progress', 'stale') AND date >= DATE '2026-01-03' ORDER BY date LIMIT 5)",
        "q30_filename_dates": f"""WITH {_CHUNKS} SELECT chunk_id, CASE chunk_id % 4 WHEN 0 THEN 'Issue-' || strftime(CAST(date AS DATE), '%d-%m-%Y') || '.pdf' WHEN 1 THEN date || '.PDF' WHEN 2 THEN 'x-31-02-2026.pdf' ELSE 'notes.pdf' END AS name, CASE WHEN chunk_id % 4 < 2 THEN date END AS date FROM chunks""",
        "q31_coerce_filters": f"""WITH {_CHUNKS}, r AS (SELECT *, CASE WHEN chunk_id % 6 = 0 THEN NULL ELSE date END AS e FROM chunks)
            SELECT chunk_id, CASE WHEN e = '2026-01-15' THEN e END AS date, CASE WHEN e IS NULL THEN '2026-01-15' WHEN e <> '2026-01-15' THEN least(e, '2026-01-15') END AS "dateFrom", CASE WHEN e <> '2026-01-15' THEN greatest(e, '2026-01-15') END AS "dateTo",
            CASE WHEN chunk_id % 3 <> 0 THEN "pageNumber" END AS "pageNumber", CASE WHEN section = 'sports' THEN 'sport' ELSE section END AS section, chunk_id % 2 = 0 AS whole FROM r""",
        "q32_json_repair": f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN chunk_id % 3 <> 0 THEN CAST(chunk_id AS VARCHAR) END AS a, chunk_id % 3 <> 0 AS valid FROM chunks",
        "q35_log_stream_equals_batch": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS level, count(*) AS n FROM events GROUP BY ALL",
        "q36_front_page": f"""WITH {_ARTICLES}, routes AS (SELECT 'own' AS route, *, section AS s FROM articles UNION ALL SELECT 'fallback', *, CASE section WHEN 'Front Page' THEN 'National' ELSE section END FROM articles),
            have AS (SELECT DISTINCT route FROM routes WHERE s = 'Front Page')
            SELECT route, id, "examRelevance", "pageNumber", row_number() OVER (PARTITION BY route ORDER BY "examRelevance" DESC, "pageNumber", created DESC, id) AS ordinal FROM routes
            WHERE CASE WHEN route IN (SELECT route FROM have) THEN s = 'Front Page' ELSE "pageNumber" = 1 AND "examRelevance" IN ('high', 'medium') END""",
        "q37_discover_counts": f"WITH {_ARTICLES}, n AS (SELECT section, count(*) AS count FROM articles GROUP BY section) SELECT * FROM n UNION ALL SELECT 'Front Page', 0 WHERE NOT EXISTS (FROM n WHERE section = 'Front Page')",
        "q38_archive": f"""WITH {_PROGRESS}, s AS (SELECT date, 's-' || CAST(date AS VARCHAR) AS filename FROM days WHERE click > purchase), h AS (SELECT date, size, "totalPages" FROM progress WHERE status <> 'missing')
            SELECT CAST(date AS VARCHAR) AS date, coalesce(filename, 'Issue-' || strftime(date, '%d-%m-%Y') || '.pdf') AS filename, CAST(CASE WHEN filename IS NULL THEN size ELSE 9 END AS BIGINT) AS "sizeBytes", CAST("totalPages" AS BIGINT) AS "totalPages", row_number() OVER (ORDER BY date DESC) AS ordinal FROM h FULL JOIN s USING (date)""",
        "q39_user_upsert": """WITH o AS (SELECT user_id, max(ts) AS at, count(*) AS c FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), n AS (SELECT user_id, max(ts) AS at, count(*) AS c, max(event_type) FILTER (event_type = 'signup') AS name FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
            SELECT CAST(user_id AS VARCHAR) AS "googleId", 'u' || user_id || '@x' AS email, coalesce(n.name, CASE WHEN o.at IS NOT NULL THEN 'old' END) AS name, CASE WHEN o.at IS NOT NULL THEN 'p' END AS picture, coalesce(o.c, 0) + coalesce(n.c, 0) AS "loginCount", epoch_us(greatest(o.at, n.at)) AS last_at FROM o FULL JOIN n USING (user_id)""",
        "q40_health": "SELECT count(*) > 0 AS ok, count(*) AS vectors FROM embeddings",
        "q41_section_report": f"WITH {_ARTICLES} SELECT section, count(*) AS count FROM articles GROUP BY section",
        "q42_sanitized_meta": """SELECT event_id, '{"JWT":"[redacted]","props":' || to_json(props) || ',"list":[1,2]}' AS meta FROM events""",
        "q43_scalar_texts": rf"""WITH {_CHUNKS}, t AS (SELECT *, regexp_replace(page_content, '^\s+|\s+$', '', 'g') AS own, chr(10) || page_content || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' || chr(9) || ' x' AS fenced FROM chunks)
            SELECT chunk_id, sha256(regexp_replace(regexp_replace(regexp_replace(lower(page_content), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS normal, sha256(regexp_replace(regexp_replace(regexp_replace(fenced, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS passage,
            '‘A title’' AS heading, sha256('date ' || date || ' | page ' || "pageNumber" || ' | section ' || section || chr(10) || page_content) AS context, sha256('Page 3 other text' || CASE WHEN own = '' THEN '' ELSE chr(10) || own END) AS lexical FROM t""",
        "q44_filtered_bm25": f"""WITH {_INDEX}, {_asked(TOPICS)}, {_bm25(10).replace("postings JOIN lexical USING (token)", 'postings JOIN lexical USING (token) JOIN chunks USING (chunk_id)').replace("WHERE TRUE", 'WHERE "pageNumber" <= 6')} SELECT CAST(topic_id AS INTEGER) AS topic_id, chunk_id, round(bm25, 6) AS bm25, rank FROM lex""",
        "q63_segment_tokens": f"WITH {_INDEX} SELECT token, df FROM rare",
        "q64_segment_bm25": f"""WITH {_INDEX}, {_asked(TOPICS)}, {_bm25(10)} SELECT CAST(topic_id AS INTEGER) AS topic_id, chunk_id, round(bm25, 6) AS bm25, rank FROM lex""",
        "q65_summary_stream": f"""WITH m AS (SELECT conv_id, turn, role, {_COLLAPSE.format("coalesce(text, '')")} AS t, lag(role) OVER w AS before, {_COLLAPSE.format("coalesce(lag(text) OVER w, '')")} AS q FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            h AS (SELECT conv_id, turn, {_clip("q", 40)} || ' / ' || {_clip("t", 40)} AS head FROM m WHERE role = 'assistant' AND before = 'user' AND q <> ''),
            s AS (SELECT conv_id, {_COLLAPSE.format("string_agg(head, ' | ' ORDER BY turn DESC)")} AS s FROM h GROUP BY conv_id), n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id)
            SELECT conv_id AS "sessionId", {_clip("s", 1600)} AS summary, n AS "summaryAtCount" FROM s JOIN n USING (conv_id)""",
        "q66_cell_search": """SELECT topic_id, chunk_id, round(cosine, 5) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY cosine DESC, chunk_id) AS rank FROM (SELECT CAST(q.vec_id AS INTEGER) AS topic_id, v.vec_id AS chunk_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cosine FROM embeddings AS v, embeddings AS q WHERE q.vec_id < 3 AND v.label IN (0, 1, 2, 3, 4))) WHERE rank <= 20""",
        "q67_regex_search": f"WITH {_ARTICLES}, x(expression, e) AS (VALUES {', '.join(f"({k}, '{e}')" for k, e in enumerate(EXPRESSIONS))}) SELECT CAST(expression AS INTEGER) AS expression, id, section FROM articles, x WHERE regexp_matches(title, e, 'i') OR regexp_matches(summary, e, 'i') OR len(list_filter(tags, lambda t: regexp_matches(t, e, 'i'))) > 0",
        "q68_deep_page": f"""WITH {_ARTICLES} SELECT id, section, "examRelevance", "pageNumber", created, ordinal, total FROM (SELECT *, row_number() OVER (ORDER BY "examRelevance" DESC, "pageNumber", created DESC, id) - 1 AS ordinal, count(*) OVER () AS total FROM articles) WHERE ordinal BETWEEN 150 AND 249""",
        "q33_layout_articles": f"""WITH {_layout()} SELECT 'pages' AS source, CAST(page_id + 1 AS INTEGER) AS "pageNumber", row_number() OVER (PARTITION BY page_id ORDER BY top < 0, top) - 1 AS article_no, heading, length(body) AS body_chars FROM articles""",
        "q69_issue_source": f"""WITH {_layout("page_id % 100 + 1")} SELECT 'Issue-' || strftime(DATE '2026-01-01' + CAST(page_id // 100 AS INTEGER), '%d-%m-%Y') || '.pdf' AS source, CAST(page_id % 100 + 1 AS INTEGER) AS "pageNumber", row_number() OVER (PARTITION BY page_id ORDER BY top < 0, top) - 1 AS article_no, heading, length(body) AS body_chars FROM articles WHERE page_id % 100 >= 1""",
        "q70_closed_windows": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS level, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type FROM events) WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL",
        "q71_live_counts": f"WITH {_ARTICLES} SELECT section, count(*) AS count FROM articles GROUP BY section",
        "q72_health_report": f"""WITH {_PROGRESS}, p AS (SELECT count(*) FILTER (status <> 'missing') AS there, count(*) FILTER (status = 'complete') AS done, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'missing') AS missing FROM progress),
            n AS (SELECT 'news' AS collection, count(*) AS v FROM embeddings UNION ALL SELECT 'none', 0), f AS (SELECT date, next_page, "totalPages" FROM progress WHERE status = 'in_progress' ORDER BY date LIMIT 1), s AS (SELECT *, v > 0 AS ok, there > 0 AND there = done AS whole FROM n, p)
            SELECT ok, ok AS "indexReady", v AS "vectorCount", collection, CASE WHEN NOT ok THEN 'Collection "' || collection || '" is empty' END AS error, CASE WHEN ok THEN whole END AS "ingestComplete", CASE WHEN ok AND NOT whole THEN CAST(date AS VARCHAR) END AS date,
            CASE WHEN ok AND NOT whole THEN CAST(next_page AS BIGINT) END AS "nextPage", CASE WHEN ok AND NOT whole THEN CAST("totalPages" AS BIGINT) END AS "totalPages", CASE WHEN ok AND NOT whole THEN pending END AS pending, CASE WHEN ok AND NOT whole THEN missing END AS missing FROM s LEFT JOIN f ON true""",
        "q45_topic_weights": f"""WITH {_INDEX}, {_asked(TOPICS)}, {_WEIGHTS}, first AS (SELECT topic_id, arg_min(token, (df, ord, token)) AS token, min(df) AS df FROM gated GROUP BY topic_id) SELECT CAST(topic_id AS INTEGER) AS topic_id, token, df, open, round(w_sem, 6) AS w_sem, round(1 - w_sem, 6) AS w_lex FROM weights LEFT JOIN first USING (topic_id)""",
        "q46_get_by_ids": f"WITH {_CHUNKS} SELECT chunk_id, date, section FROM chunks WHERE chunk_id IN (SELECT item_id * 3 FROM benchmark WHERE item_id > 0)",
        "q47_discover_files": f"""WITH {_CHUNKS}, f AS (SELECT DISTINCT chunk_id % 4 AS k, date, "dateInt" AS seen, CASE chunk_id % 4 WHEN 0 THEN 'in/x-' || strftime(CAST(date AS DATE), '%d-%m-%Y') || '.pdf' WHEN 1 THEN 'in/' || date || '.PDF' END AS path FROM chunks)
            SELECT date, max(path) AS source, CAST(max(seen) AS BIGINT) * 1000 AS mtime FROM f WHERE k < 2 GROUP BY date UNION ALL SELECT NULL, 'notes.pdf', count(DISTINCT seen) FROM f WHERE k = 3 HAVING count(*) > 0""",
        "q48_resolve_issue": f"""WITH {_PROGRESS}, a AS (SELECT CAST(date AS VARCHAR) AS date, status, size, "totalPages", status <> 'missing' AS has, true AS valid FROM progress UNION ALL VALUES ('', NULL, NULL, NULL, false, true), ('2026-02-30', NULL, NULL, NULL, false, false), ('today', NULL, NULL, NULL, false, false), ('2031-05-06', NULL, NULL, NULL, true, true)),
            n AS (SELECT *, CASE WHEN date = '' THEN 'latest.pdf' WHEN has THEN 'Issue-' || strftime(CAST(date AS DATE), '%d-%m-%Y') || '.pdf' END AS filename FROM a)
            SELECT date, valid, filename, CASE WHEN filename IS NOT NULL THEN '/api/manual' || CASE WHEN date = '' THEN '' ELSE '?date=' || date END END AS url, 'https://store.example/issues/' || filename AS "remoteUrl", CAST(CASE WHEN has THEN "totalPages" END AS BIGINT) AS "totalPages", CASE WHEN has THEN size END AS "sizeBytes" FROM n""",
        "q49_calendar_summary": f"""WITH {_PROGRESS} SELECT coalesce(bool_and(status = 'complete') FILTER (status <> 'missing'), false) AS complete, CAST(sum("vectorCount") AS BIGINT) AS "vectorCount", string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (status = 'missing') AS missing FROM progress""",
        "q50_curation_report": f"""WITH {_CHUNKS}, {_CURATION}, r AS (SELECT heading AS source, "pageNumber", count(*) AS raw FROM prepared GROUP BY ALL), k AS (SELECT source, "pageNumber", count(*) AS kept FROM kept GROUP BY ALL) SELECT source, "pageNumber", raw, coalesce(kept, 0) AS kept, raw - coalesce(kept, 0) AS dropped FROM r LEFT JOIN k USING (source, "pageNumber")""",
        "q51_public_sessions": rf"""WITH m AS (SELECT conv_id, role, text, turn FROM conversations WHERE role <> 'system'), t AS (SELECT conv_id, {_COLLAPSE.format("coalesce(arg_min(text, turn) FILTER (role = 'user'), '')")} AS q, {_COLLAPSE.format("arg_max(text, turn)")} AS p, count(*) AS n FROM m GROUP BY conv_id)
            SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN q = '' THEN 'New chat' WHEN length(q) > 60 THEN substr(q, 1, 57) || '…' ELSE q END AS title, least(length(p), 200) AS chars, n FROM t UNION ALL SELECT CAST(conv_id * 1000 + turn AS VARCHAR), role, length(text), 1 FROM m""",
        "q52_compact_sources": f"""WITH {_CHUNKS}, s AS (SELECT *, row_number() OVER (PARTITION BY date, "pageNumber" ORDER BY chunk_id) - 1 AS place FROM chunks) SELECT date, "pageNumber", place AS "at", chunk_id AS id, CASE WHEN chunk_id % 2 = 0 THEN heading ELSE '' END AS heading, least(length(page_content), 400) AS chars FROM s WHERE place < 20""",
        "q53_recent_sessions": rf"""WITH m AS (SELECT conv_id, role, text, turn FROM conversations WHERE role <> 'system' AND conv_id % 7 = 3), t AS (SELECT conv_id, {_COLLAPSE.format("coalesce(arg_min(text, turn) FILTER (role = 'user'), '')")} AS q, conv_id * 3600 + max(turn) * 60 AS last FROM m GROUP BY conv_id)
            SELECT conv_id AS "sessionId", CASE WHEN q = '' THEN 'New chat' WHEN length(q) > 60 THEN substr(q, 1, 57) || '…' ELSE q END AS title, row_number() OVER (ORDER BY last DESC, conv_id) AS ordinal FROM t ORDER BY ordinal LIMIT 100""",
        "q54_public_articles": f"WITH {_ARTICLES} SELECT CAST(id AS VARCHAR) AS id, title, section, length(summary) AS chars, CAST(len(tags) AS BIGINT) AS tags, CAST(0 AS BIGINT) AS \"wordCount\", created FROM articles",
        "q15_pack_sentences": f"""WITH RECURSIVE {_CHUNKS}, {_pack_sentences(200, 20)}, p AS (SELECT chunk_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS place FROM packed)
            SELECT chunk_id, CAST(place AS INTEGER) AS "at", CAST(len(string_split(piece, ' ')) AS INTEGER) AS n_words, sha256(piece) AS digest FROM p""",
        "q34_line_segments": f"""WITH {_PAGE_LINES} SELECT CAST(page_id + 1 AS INTEGER) AS "pageNumber", CAST(line_no AS INTEGER) AS line_no, text, CAST(col AS INTEGER) AS col FROM lines""",
        "q55_built_filters": f"""WITH {_CHUNKS} SELECT 0 AS filter, chunk_id, date, "pageNumber", section FROM chunks WHERE "dateInt" BETWEEN 20260108 AND 20260120 AND section IN ('sport', 'SPORT', 'Sport', 'sports', 'SPORTS', 'Sports')
            UNION ALL SELECT 1, chunk_id, date, "pageNumber", section FROM chunks WHERE date = '2026-01-11' UNION ALL SELECT 2, chunk_id, date, "pageNumber", section FROM chunks WHERE date = '2026-01-09' AND "pageNumber" = 5
            UNION ALL SELECT 3, chunk_id, date, "pageNumber", section FROM chunks WHERE "dateInt" <= 20260102""",
        "q56_hybrid_fallbacks": f"WITH {_hybrid([(0, 'the of and into'), (1, 'thanea onthe reporting')], 8)} SELECT CAST(topic_id AS INTEGER) AS topic_id, chunk_id, round(score, 6) AS score, sem_rank, lex_rank, rank FROM fused",
        "q57_stored_chunks": f"""WITH RECURSIVE {_CHUNKS}, {_pack_sentences(200, 20)}, own AS (SELECT chunk_id, CASE WHEN trim(page_content) = '' THEN [heading || ' ' || chunk_id] ELSE pieces END AS pieces FROM chunks LEFT JOIN packed USING (chunk_id)),
            p AS (SELECT chunk_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i, len(pieces) AS n FROM own),
            t AS (SELECT p.*, c.date, c."dateInt", c."pageNumber", c.section, c.heading || ' ' || c.chunk_id AS h FROM p JOIN chunks AS c USING (chunk_id)),
            b AS (SELECT *, CASE WHEN piece = h THEN '' WHEN starts_with(piece, h || chr(10)) OR starts_with(piece, h || ' ') THEN trim(substr(piece, length(h) + 1)) ELSE piece END AS body FROM t),
            w AS (SELECT *, 'date - ' || date || chr(10) || 'heading - ' || h || chr(10) || 'chunk ' || i || '/' || n || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END AS content FROM b)
            SELECT sha256(concat_ws('|', date, 'issue', "pageNumber", h, i, content)) AS chunk_id, date, "dateInt", "pageNumber", "pageNumber" AS "pageStart", section, substr(h, 1, 350) AS heading, i AS "chunkIndex", n AS "chunkTotal", sha256(content) AS content FROM w""",
        "q58_console_lines": """SELECT event_id, CASE event_type WHEN 'view' THEN 'page/' || user_id WHEN 'error' THEN 'server' WHEN 'click' THEN 'rag' ELSE 'console' END AS source, 'In an another ' || event_type || ' Next' AS joined FROM events""",
        "q59_public_users": """SELECT CAST(user_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS email, false AS "emailVerified", max(event_type) FILTER (event_type = 'signup') AS name, CAST(NULL AS VARCHAR) AS picture, 'google' AS provider, count(*) AS "loginCount", epoch_us(max(ts)) AS last_at FROM events GROUP BY user_id""",
        "q60_articles_by_source": f"""WITH {_ARTICLES} SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY "pageNumber", created, id) AS ordinal FROM (SELECT *, tags[2] || '.pdf' AS source FROM articles)""",
        "q61_marked_progress": f"""WITH {_PROGRESS}, p AS (SELECT date, status, next_page, "vectorCount", "totalPages", date = DATE '2026-01-07' AS own FROM progress)
            SELECT 'mark' AS after, CAST(date AS VARCHAR) AS date, CASE WHEN own THEN 'complete' ELSE status END AS status, CAST(CASE WHEN own THEN 17 ELSE next_page END AS BIGINT) AS next_page, CAST(CASE WHEN own THEN 99 ELSE "vectorCount" END AS BIGINT) AS "vectorCount", CAST("totalPages" AS BIGINT) AS "totalPages" FROM p
            UNION ALL SELECT 'reset', CAST(date AS VARCHAR), CASE WHEN status = 'missing' THEN status ELSE 'pending' END, CASE WHEN status = 'missing' THEN next_page ELSE 1 END, CASE WHEN status = 'missing' THEN "vectorCount" ELSE 0 END, CASE WHEN status = 'missing' THEN "totalPages" END FROM p""",
        "q62_recurated_pages": f"""WITH {_ARTICLES} SELECT id, tags[2] || '.pdf' AS source, "pageNumber" FROM articles WHERE NOT (tags[2] = 'src3' AND "pageNumber" >= 9)""",
    }
