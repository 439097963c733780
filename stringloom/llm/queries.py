"""Queries `opN_<name>` with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stringloom.llm import chat_format, cross_polytope, dart_minhash, decontaminate, interpolation_lm, lang_id, sentencepiece_viterbi, substring_dedup, suffix_array_dedup, virtual_slots
from stringloom.llm.shared import shared_folder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.op1(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.op3(table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation_lm.op4(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.op5(table(spark, sf_dir, "embeddings"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{SAID}'), (-7L, 1L, 'assistant', '{SAID}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.formatted(turns))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.op7(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.op8(spark, table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op9(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language_model": op4_language_model,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

SAID = "</s>[INST] ok [/INST]"
CONTROL = r"(<|\[)(/?(?:s>|INST\]|SYS\]|ROLE\])|NEXT\])"
#: Words of a text after lower-casing A-Z only.
ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_decontamination": f"""WITH i AS (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, len(pat) AS m, array_to_string(pat, ' ') AS pat FROM (SELECT item_id, w[a : a + least(10, len(w)) - 1] AS pat
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM i WHERE len(w) > 0))),
d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
g AS (SELECT doc_id, a, m, array_to_string(w[a : a + m - 1], ' ') AS pat FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT g.doc_id, g.a, g.m, p.item_id FROM g JOIN p ON p.pat = g.pat),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + m)) AS x FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op3_near_duplicates": f"""WITH RECURSIVE d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[a : a + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS a FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c >= 0.8 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, min(other) AS component_id, min(other) = d.doc_id AS kept, coalesce(min(n.n), 0)::BIGINT AS n_shingles FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS size FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: c * c)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_inner_product(p.x, q.x) / (p.size * q.size) >= 0.95),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, min(other) AS component_id, min(other) = v.vec_id AS kept FROM v JOIN r ON r.vec_id = v.vec_id GROUP BY v.vec_id""",
    "op6_chat_formatting": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
o AS (SELECT *, lag(role) OVER w AS b, lead(role) OVER w AS f FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
m AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '{CONTROL}', '\1\\\2', 'g'))
  + CASE WHEN b IS DISTINCT FROM role THEN CASE role WHEN 'user' THEN 7 WHEN 'system' THEN 6 WHEN 'assistant' THEN 3 ELSE 13 + length(regexp_replace(replace(role, '\', '\\'), '{CONTROL}', '\1\\\2', 'g')) END ELSE 6 END
  + CASE WHEN f IS DISTINCT FROM role THEN CASE role WHEN 'user' THEN 8 WHEN 'system' THEN 7 ELSE 4 END ELSE 0 END AS n FROM o),
l AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM l""",
    "op9_substring_dedup": f"""WITH d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
g AS (SELECT doc_id, a, array_to_string(w[a : a + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS a FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, a FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
x AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(a, a + 13)) AS x FROM f) GROUP BY 1),
k AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) d
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.a <= d.i AND d.i < f.a + 13) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op10_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM s) WHERE k > 1),
b AS (SELECT doc_id, h, unnest(range(0, n)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM f)),
m AS (SELECT b.doc_id, b.p, substr(h, 2 * b.p + 1, 2) AS x, max(f.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.p = b.p),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept
  FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS before FROM m) GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
}
