"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from revlens.llm import (
    bpe,
    digest,
    importance,
    langid,
    lexical,
    licenses,
    mixing,
    ngram_join,
    pivot_index,
    token_counts,
    token_files,
    toxicity,
    url_templates,
)
from revlens.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_table(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_paragraphs(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages")).drop("purity")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("rate")


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return pivot_index.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_files": op2_token_files,
    "op3_licenses": op3_licenses,
    "op4_langid": op4_langid,
    "op5_url_templates": op5_url_templates,
    "op7_mixing": op7_mixing,
    "op6_digest": op6_digest,
    "op8_pivot_index": op8_pivot_index,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_lexical": op11_lexical,
    "op12_token_counts": op12_token_counts,
    "op13_importance": op13_importance,
}
OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT k, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM d GROUP BY k),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, c GROUP BY term),
i AS (SELECT tf.k, n.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n.n * big_n) // big_l))) AS x
  FROM tf JOIN w USING (term) JOIN n ON n.k = tf.k CROSS JOIN c),
s AS (SELECT item_id, k, any_value(doc_id) AS doc_id, sum(x)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
OP13_SQL = r"""
WITH words AS (SELECT 'd' AS part, row_number() OVER () AS k, doc_id, regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
 UNION ALL SELECT 'b', NULL, NULL, regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (SELECT part, k, unnest(list_concat(w, list_concat(
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM words),
f AS (SELECT part, k, f, count(*)::BIGINT AS n FROM runs GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(h), 2),
   lambda i: list_transform(range(8), lambda j: ((('0x' || substr(h, i + 1, 2))::BIGINT >> j) & 1))))),
   lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 10000 AS b FROM h),
c AS (SELECT b, sum(n) FILTER (part = 'd') AS s, sum(n) FILTER (part = 'b') AS t FROM f JOIN b USING (f) GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM c),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM c, tot),
x AS (SELECT k, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE part = 'd' GROUP BY k),
d AS (SELECT doc_id, coalesce(len(w), 0) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
 FROM words LEFT JOIN x USING (k) WHERE part = 'd'),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((hash + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
  count(*) FILTER (words >= 20) OVER () AS eligible FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * eligible // 100 THEN place END AS rank FROM r
"""


def op5_sql() -> str:
    """The path-template tree level by level, as common table expressions."""
    u = url_templates
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
            for h, p, v in sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in fits)
    listed = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    segments = ", ".join(
        f"CASE WHEN regexp_full_match(coalesce(string_split(path, '/')[{k + 1}], ''), "
        f"'[0-9]+(\\.[A-Za-z0-9]+)?') THEN '{{n}}' ELSE coalesce(string_split(path, '/')[{k + 1}], '') END AS s{k}"
        for k in range(1, u.DEPTH + 1))
    s = ", ".join(u.SEGMENTS)
    out = [f"""u0 AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
           f"u AS (SELECT *, CASE {rule} END AS rule, CASE {listed} END AS listed, {segments} FROM u0)",
           f"""r0 AS (SELECT host, {s}, count(*) AS n, count(listed) AS m, count(*) FILTER (listed = 'block') AS b,
  '' AS node FROM u GROUP BY ALL)"""]
    for k in range(1, u.DEPTH + 1):
        out += [f"""b{k} AS (SELECT host, node, s{k}, sum(n) AS n, sum(m)::DOUBLE AS m, sum(b)::DOUBLE AS b
  FROM r{k - 1} GROUP BY ALL)""",
                f"""z{k} AS (SELECT *, n < {u.MIN_SHARE}::DOUBLE * sum(n) OVER (PARTITION BY host, node) AS rare FROM b{k})""",
                f"""w{k} AS (SELECT *, bool_or(rare) OVER p AS any_rare,
  sum(CASE WHEN rare THEN m ELSE 0 END) OVER p AS wm, sum(CASE WHEN rare THEN b ELSE 0 END) OVER p AS wb
  FROM z{k} WINDOW p AS (PARTITION BY host, node))""",
                f"""t{k} AS (SELECT host, node, s{k}, CASE WHEN rare OR (any_rare AND m > 0 AND wm > 0
  AND (b / m - wb / wm) * (b / m - wb / wm) <= {u.MERGE_Z * u.MERGE_Z}::DOUBLE *
   (((b + wb) / (m + wm)) * (1 - (b + wb) / (m + wm)) * (1 / m + 1 / wm))) THEN '*' ELSE s{k} END AS t FROM w{k})""",
                f"""r{k} AS (SELECT r.* EXCLUDE (node), r.node || '/' || t.t AS node FROM r{k - 1} r
  JOIN t{k} t ON r.host = t.host AND r.node = t.node AND r.s{k} = t.s{k})"""]
    w = f"{u.WEIGHT}::DOUBLE"
    out += [f"tp AS (SELECT host, node, sum(b)::DOUBLE AS b, sum(m)::DOUBLE AS m FROM r{u.DEPTH} GROUP BY ALL)",
            """h AS (SELECT host, sum(b)::DOUBLE AS hb, sum(n)::DOUBLE AS hn,
  array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM r0 GROUP BY ALL)""",
            "d AS (SELECT domain, sum(hb) AS db, sum(hn) AS dn FROM h GROUP BY ALL)",
            "p0 AS (SELECT coalesce(sum(hb) / sum(hn), 0) AS p FROM h)",
            f"""hp AS (SELECT host, (hb + {w} * ((db + {w} * p) / (dn + {w}))) / (hn + {w}) AS p
  FROM h JOIN d USING (domain) CROSS JOIN p0)""",
            f"tq AS (SELECT tp.host, tp.node, (b + {w} * p) / (m + {w}) AS purity FROM tp JOIN hp USING (host))"]
    return "WITH " + ",\n".join(out) + f"""
SELECT u.page_id, u.host, u.path, u.rule,
 coalesce(u.listed, CASE WHEN q.purity >= {u.REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
 r.node AS template
FROM u JOIN r{u.DEPTH} r ON u.host = r.host AND {' AND '.join(f'u.{x} = r.{x}' for x in u.SEGMENTS)}
JOIN tq q ON q.host = r.host AND q.node = r.node"""


ORACLE: dict[str, str] = {"op5_url_templates": op5_sql(), "op8_pivot_index": OP8_SQL,
                          "op11_lexical": OP11_SQL, "op13_importance": OP13_SQL}
