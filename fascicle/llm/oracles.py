"""DuckDB SQL of the cohort matrix, spelling variants and the mix, straight from their definitions."""

from __future__ import annotations

from fascicle.llm import cohort_retention as cohort
from fascicle.llm import mix_sources, spelling_groups

#: crc32 needs its table of 256 entries, made by the rule of the polynomial.
CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32(text: str) -> str:
    """SQL of the crc32 of a text's UTF-8 bytes; `tab` must be in scope."""
    h = f"hex(encode({text}))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])))"


def retention_sql(cut: str = "2024-02-01 00:00:00") -> str:
    """Both states from scratch."""
    return f"""
WITH {CRC_TABLE},
c AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT c.*, {crc32("click_id::VARCHAR")} AS h FROM c, tab),
a AS (SELECT client_id, epoch_us(ts) AS us, kind, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents, arrived_at + to_days(CASE WHEN h % 3 = 0 THEN CAST(h % 100 AS INTEGER) ELSE 0 END) < TIMESTAMP '{cut}' AS early FROM h),
k AS (SELECT 0 AS state, client_id, us, kind, cents FROM a WHERE early UNION ALL SELECT 1, client_id, us, kind, cents FROM a),
s AS (SELECT state, client_id, min(us) AS start FROM k WHERE kind = '{cohort.START_KIND}' GROUP BY ALL),
m AS (SELECT client_id FROM s GROUP BY client_id HAVING count(DISTINCT start // {cohort.WEEK}) > 1),
u AS (SELECT k.state, client_id, start // {cohort.WEEK} AS cohort, (us - start) // {cohort.WEEK} AS period, sum(cents) AS cents FROM k JOIN s USING (state, client_id) WHERE us >= start GROUP BY ALL),
n AS (SELECT client_id, min(source) AS segment FROM clients GROUP BY client_id),
i AS (SELECT client_id, {crc32("client_id::VARCHAR")} AS crc FROM (SELECT DISTINCT client_id FROM s), tab)
SELECT state::INTEGER AS state, coalesce(segment, '') AS segment, cohort, period, count(*) AS users, CAST(sum(crc) AS BIGINT) AS users_crc32, count(m.client_id) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM u JOIN i USING (client_id) LEFT JOIN n USING (client_id) LEFT JOIN m USING (client_id) GROUP BY state, coalesce(segment, ''), cohort, period"""


def spelling_sql() -> str:
    s = spelling_groups
    return f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{s.RUN}')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM d, tab),
o AS (SELECT CASE WHEN h % {s.LOSS} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= {s.LENGTH} GROUP BY word HAVING sum(n) >= {s.COUNT}),
k AS (SELECT DISTINCT word, n, key FROM (SELECT word, n, word AS key FROM w UNION ALL SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w))),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word
  WHERE CASE length(a.word) - length(b.word) WHEN 0 THEN len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1 WHEN 1 THEN a.key = b.word WHEN -1 THEN b.key = a.word ELSE false END),
x AS (SELECT word, m, other, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {s.RATIO} * w.n THEN other END AS form, CASE WHEN m >= {s.RATIO} * w.n THEN m END AS form_n FROM w LEFT JOIN x ON x.word = w.word AND place = 1),
up(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.form)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.form IS NULL"""


def mix_sql() -> str:
    m = mix_sources
    weight = "CASE " + " ".join(f"WHEN (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(m.WEIGHTS)} = {k} THEN {v}" for k, v in enumerate(m.WEIGHTS)) + " END"
    start = lambda draw: f"""({crc32(f"'{m.SEED}:{draw}' || coalesce(':' || source, '')")} % {m.UNIT})"""
    part = lambda e: f"CAST(round(({e} - floor({e})) * {m.UNIT}) AS BIGINT)"
    copies = lambda e: f"CAST(floor({e}) AS BIGINT) + CASE WHEN ({part(e)} * (place % {m.UNIT}) + start) % {m.UNIT} + {part(e)} >= {m.UNIT} THEN 1 ELSE 0 END"
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {weight} AS weight FROM d GROUP BY source),
-- The rate rises until it holds no further source at its most.
r(k, rate) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT k + 1, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum({m.MOST} * source_size) FROM s WHERE weight * rate > {m.MOST} * source_size), 0))::DOUBLE / (SELECT sum(weight) FROM s WHERE weight * rate <= {m.MOST} * source_size)::DOUBLE FROM r WHERE k < 60),
g AS (SELECT s.*, CASE WHEN weight * rate > {m.MOST} * source_size THEN ({m.MOST} * source_size)::DOUBLE ELSE weight * rate END AS target, {start(0)} AS start0, {start(1)} AS start1 FROM s, tab, (SELECT max(rate) AS rate FROM r)),
i AS (SELECT doc_id, source, size, {crc32("coalesce(doc_id::VARCHAR, '')")} AS tie FROM d, tab),
o AS (SELECT doc_id, i.source, size, source_size, target, start0, start1, CASE WHEN {m.LARGE} * size <= source_size THEN 1 ELSE 0 END AS draw, tie FROM i JOIN g ON i.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, row_number() OVER (PARTITION BY source, draw ORDER BY size, tie, doc_id NULLS FIRST) - 1 AS place FROM o),
f AS (SELECT *, {copies("e")} AS copies FROM (SELECT *, start0 AS start, CASE WHEN source_size > 0 THEN least({float(m.MOST)}::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS e FROM p WHERE draw = 0)),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS large, CAST(sum(copies * size) AS BIGINT) AS drawn FROM f GROUP BY source),
l AS (SELECT p.*, start1 AS start, CASE WHEN source_size - coalesce(large, 0) > 0 THEN greatest(0.0::DOUBLE, least({float(m.MOST)}::DOUBLE, (target - coalesce(drawn, 0)) / (source_size - coalesce(large, 0)))) ELSE 0.0::DOUBLE END AS e FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source WHERE draw = 1)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM f UNION ALL SELECT doc_id, size, source_size, target, CAST(({copies("e")}) * size AS BIGINT) FROM l"""
