"""The registered queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm import bestfit_pack, bpe_prefix, chat_format, cohort_retention, embed_pstable, langid_bloom, license_join, mix_sources, oracles, quality_cascade, simhash_vptree, spelling_groups, toxicity_nbsvm, url_reputation
from fascicle.llm.common import fold, read


def tokenizer_file(name: str) -> bytes:
    """A public tokenizer's file, read on the driver; executors get its bytes."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity_nbsvm.fit(docs, read(spark, sf_dir, "labels"), train_fold=~held_out)
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity_nbsvm.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid_bloom.fit(docs, train_fold=~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), langid_bloom.predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_pstable.embedding_groups(read(spark, sf_dir, "embeddings"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables label documents; a page takes the quality label of its number.
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), outcomes)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality_report(read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(extra)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_prefix.encoding_report(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_pack.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode())


def op11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_retention.retention(read(spark, sf_dir, "clicks"), read(spark, sf_dir, "clients"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(read(spark, sf_dir, "documents"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _license_sql() -> str:
    """Brute force: the block at every word of every text that holds enough tokens, against every template."""
    templates = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))}, {ceil(license_join.THRESHOLD * len(set(t.split())) - 1e-9)})" for k, (label, t) in enumerate(license_join.TEMPLATES))
    phrases = ", ".join(f"('{label}', {p.split()}, {len(p.split())})" for p, label in license_join.PHRASES)
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(k, label, tokens, need) AS (VALUES {templates}),
p(label, tokens, n) AS (VALUES {phrases}),
c AS (SELECT DISTINCT doc_id, w FROM d, t WHERE len(list_intersect(list_distinct(w), t.tokens)) >= need),
b AS (SELECT doc_id, list_distinct(list_slice(w, s, s + {license_join.BLOCK - 1})) AS block FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM c)),
m AS (SELECT doc_id, label, max(len(list_intersect(block, t.tokens)) / len(t.tokens)) AS share FROM b, t WHERE len(list_intersect(block, t.tokens)) >= need GROUP BY ALL),
a AS (SELECT doc_id, label, pos - 1 AS pos FROM (SELECT doc_id, w, p.label, p.tokens, p.n, unnest(range(1, len(w) - p.n + 2)) AS pos FROM d, p WHERE list_contains(w, p.tokens[1])) WHERE list_slice(w, pos, pos + n - 1) = tokens),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM a GROUP BY doc_id),
every_label AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM a UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every_label USING (doc_id) LEFT JOIN best USING (doc_id)"""


def _url_sql() -> str:
    fits = sorted(url_reputation.RULES, key=lambda r: -len(r[1] + r[2]))
    when = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in fits) + " END"
    u, second = url_reputation, "|".join(url_reputation.SECOND_LEVEL)
    strength = lambda n, bad, prior, table: (
        f"(SELECT coalesce(1 / greatest(1 / {u.MOST + 1}::DOUBLE, least(over_ / room, 1 / {u.LEAST + 1}::DOUBLE)) - 1, {u.USUAL}::DOUBLE) FROM (SELECT sum({n} * ({bad} / {n} - {prior}) * ({bad} / {n} - {prior}) - {prior} * (1 - {prior})) AS over_, nullif(greatest(sum({prior} * (1 - {prior}) * ({n} - 1)), 0), 0) AS room FROM {table} WHERE {n} > 0))"
    )
    soft = lambda t: f"(greatest({t}, 0) + ln(1 + exp(-abs({t}))))"
    t = f"(cut + deviation * SIGN * {u.STEP}::DOUBLE * k)"
    side = f"list_sum(list_transform(range(0, {u.REACH + 1}), lambda k: CASE WHEN k IN (0, {u.REACH}) THEN 1.0::DOUBLE WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(a * ({t} - mode) - (a + b) * ({soft(t)} - {soft('mode')}))))"
    above, below = side.replace("SIGN", "1"), side.replace("SIGN", "-1")
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\\.*$', '') AS bare FROM u LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, CASE WHEN regexp_matches(bare, '^[0-9]+(\\.[0-9]+){{3}}$') THEN bare ELSE coalesce(nullif(regexp_extract(bare, '([^.]+\\.(?:(?:{second})\\.[a-z]{{2}}|[^.]+))$', 1), ''), bare) END AS domain,
  CASE WHEN regexp_matches(bare, '^[0-9]+(\\.[0-9]+){{3}}$') THEN '' WHEN regexp_matches(bare, '(^|\\.)({second})\\.[a-z]{{2}}$') THEN regexp_extract(bare, '((?:{second})\\.[a-z]{{2}})$', 1) ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS db FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb FROM d GROUP BY ALL),
w AS (SELECT coalesce(sum(sb), 0) AS wb, coalesce(sum(sn), 0) AS wn FROM s),
sp AS (SELECT s.*, (wb - sb + 0.5::DOUBLE) / (wn - sn + 1.0::DOUBLE) AS s_prior FROM s, w),
ss AS (SELECT {strength("sn", "sb", "s_prior", "sp")} AS k),
dp AS (SELECT d.*, (sb - db + k * s_prior) / (sn - dn + k) AS d_prior FROM d JOIN sp USING (suffix), ss),
ds AS (SELECT {strength("dn", "db", "d_prior", "dp")} AS k),
hp AS (SELECT h.host, n, bad, (db - bad + k * d_prior) / (dn - n + k) AS h_prior FROM h JOIN dp USING (domain, suffix), ds),
hs AS (SELECT {strength("n", "bad", "h_prior", "hp")} AS k),
ab AS (SELECT host, bad + k * h_prior + 0.5::DOUBLE AS a, n - bad + k * (1 - h_prior) + 0.5::DOUBLE AS b FROM hp, hs),
z AS (SELECT host, a, b, ln(a / b) AS mode, sqrt(1 / a + 1 / b) AS deviation, ln({u.LIMIT / (1 - u.LIMIT)}::DOUBLE) AS cut FROM ab),
x AS (SELECT *, {above} AS above, {below} AS below FROM z),
r AS (SELECT host, CASE WHEN cut - mode < -8 * deviation THEN 1 WHEN cut - mode > 8 * deviation THEN 0 ELSE above / (above + below) END AS over_ FROM x)
SELECT page_id, host, path, {when(lambda r: r[1] + r[2])} AS rule,
  coalesce({when(lambda r: r[0])}, CASE WHEN host <> '' AND over_ >= {u.CONFIDENCE} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN r USING (host)"""


QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, p, list_slice(w, p, p + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, range(8) AS x(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR 100 * n_upper > 60 * word_chars) AS kept
FROM m"""

CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS x, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN role = before THEN 8 ELSE length(role) + 17 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def queries():
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_licenses, op4_language, op5_embeddings, op6_urls, op7_quality, op8_chat, op9_bpe, op10_packing, op11_retention, op12_spelling, op13_mix)} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": _license_sql(), "op6_urls": _url_sql(), "op7_quality": QUALITY_SQL, "op8_chat": CHAT_SQL, "op11_retention": oracles.retention_sql(), "op12_spelling": oracles.spelling_sql(), "op13_mix": oracles.mix_sql()}
