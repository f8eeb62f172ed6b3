"""Named queries of the training-data operators over whole tables, with comparison SQL where the operator can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from provalake.llm import byte_bpe, chat_preferences, html_text, minhash, mixing, phrase_mining, quality_classifier, quality_rules, suffix_dedup, token_alignment, token_files, topk, toxicity
from provalake.llm.common import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
             CAST(strlen(text) - strlen(regexp_replace(text, '[^\x00-\x7F]|[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(8) t(j) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
  + (CASE WHEN 100 * n_upper > 40 * n_letters THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_upper, n_letters, fail_bits FROM b
""")
def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"))


@query("op8_minhash")
def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op9_topk(spark, sf_dir):
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


@query("op10_chat_preferences", """
WITH s AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns,
  max(CASE WHEN role = 'assistant' THEN n END) AS last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM s) GROUP BY conv_id),
a AS (SELECT * FROM t WHERE last IS NOT NULL),
p AS (SELECT x.conv_id AS pair_id, x.turns AS c, list_concat(x.turns[1:x.last - 1], [y.turns[y.last]]) AS r FROM a x JOIN a y ON y.conv_id = xor(x.conv_id, 1)),
k AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS NOT DISTINCT FROM r[i]), false) - 1, len(c)) AS n FROM p),
f AS (SELECT pair_id, CAST(n AS BIGINT) AS prompt_turns, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM k)
SELECT pair_id, prompt_turns,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(c, lambda t: '0:' || (length(t.role) + 5) || (CASE WHEN t.role = 'assistant' THEN ' 1:' ELSE ' 0:' END) || (length(t.text) + 8)), ' '), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(r, lambda t: '0:' || (length(t.role) + 5) || (CASE WHEN t.role = 'assistant' THEN ' 1:' ELSE ' 0:' END) || (length(t.text) + 8)), ' '), '') AS rejected_mask,
  CAST(coalesce(list_sum(list_transform(c, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 8 ELSE 0 END)), 0) AS BIGINT) AS chosen_learnt,
  CAST(coalesce(list_sum(list_transform(r, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 8 ELSE 0 END)), 0) AS BIGINT) AS rejected_learnt
FROM f
""")
def op10_chat_preferences(spark, sf_dir):
    return chat_preferences.format_pairs(chat_preferences.replaced_answers(table(spark, sf_dir, "conversations")))


@query("op5_mixing")
def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.labelled_by(docs, "lang"), mixing.TARGETS)


@query("op4_html_text")
def op4_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op13_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM late)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, b - a AS gone, 1 AS span FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n), 0, 0 FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(span) AS BIGINT) AS n_spans,
  sha256(unhex(string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b))) AS kept_sha256
FROM d JOIN gaps USING (doc_id) GROUP BY d.doc_id, d.n
""")
def op13_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op12_phrase_mining", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')) AS gs FROM w, range(1, 4) t(k)),
f AS (SELECT lang, k, g, count(*) AS a FROM (SELECT lang, k, unnest(gs) AS g FROM g) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, a, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
longer AS (SELECT lang, array_to_string(ws[j:j + 1], ' ') AS g, max(a) AS longer FROM c, range(1, 3) t(j) WHERE k = 3 GROUP BY ALL),
cut AS (SELECT c.lang, c.g, c.a, j, x.a AS l, y.a AS r, (1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS score FROM c, range(1, 3) t(j)
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.g = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.g = array_to_string(ws[j + 1:], ' ')
  WHERE j < c.k),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
""")
def op12_phrase_mining(spark, sf_dir):
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    return token_alignment.align(table(spark, sf_dir, "documents"))
