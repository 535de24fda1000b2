"""Queries of the subpackage, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import chat, clusters, divergence, factors, licences, media, mixing, neardup, packing, pii, quality, substrings, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "op2_near_duplicates",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w
), c AS (SELECT sh_key, min(doc_id) AS rep, any_value(sh) AS sh FROM (SELECT *, md5(array_to_string(list_sort(sh), chr(10))) AS sh_key FROM s WHERE len(sh) > 0) GROUP BY sh_key
), items AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM c
), pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), r(rep, other) AS (SELECT rep, rep FROM c UNION SELECT r.rep, e.b FROM r JOIN e ON r.other = e.a
), comp AS (SELECT rep, min(other) AS component_id FROM r GROUP BY rep
), cls AS (SELECT sh_key, component_id FROM c JOIN comp USING (rep))
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(cls.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(cls.component_id, s.doc_id) AS kept
FROM s LEFT JOIN cls ON len(s.sh) > 0 AND md5(array_to_string(list_sort(s.sh), chr(10))) = cls.sh_key
""",
)
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, similarity=0.8)


@register(
    "op5_substring_dedup",
    r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN least USING (h) WHERE doc_id > d
), g AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""",
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=13)


@register("op1_media_columns")
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register(
    "op10_exact_top_k",
    """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid AS q, q.vec_id AS query_id, c.rid AS c, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
)
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64, query_mod=20)


@register("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repetitions=corpus_pipeline.REPETITIONS)


@register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register(
    "op6_perspectives",
    """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t
), r AS (
  SELECT t.*, s.perspective, speaker = perspective AS mine,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM r
), p AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g
)
SELECT conv_id, perspective, turn, speaker, CASE WHEN mine THEN 'assistant' ELSE 'user' END AS chat_role, segment, start, start + length(segment) AS "end",
  CASE WHEN mine THEN start + length(head) END AS mask_start, CASE WHEN mine THEN start + length(segment) - 11 END AS mask_end
FROM p
""",
)
def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@register("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str, lines: bool = True) -> str:
    """The canonical form by lists of words."""
    out = f"translate({text}, '{licences.UPPER}', '{licences.LOWER}')"
    if lines:
        out = f"array_to_string(list_filter(string_split({out}, chr(10)), lambda x: NOT regexp_matches(x, {_quoted(licences.COPYRIGHT)})), chr(10))"
    cases = " ".join(f"WHEN {_quoted(other)} THEN {_quoted(one)}" for other, one in licences.SPELLINGS if " " not in other)
    words = f"list_transform(list_filter(string_split_regex({out}, {_quoted(licences.BETWEEN)}), lambda x: x <> ''), lambda x: CASE x {cases} ELSE x END)"
    out = f"(' ' || array_to_string({words}, '  ') || ' ')"
    for other, one in licences.SPELLINGS:
        if " " in other:
            out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one} ')"
    return f"trim(replace({out}, '  ', ' '))"


LICENCES_SQL = f"""
WITH texts AS (SELECT id, t FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in (*licences.TEXTS, *licences.NOTICES))}) k(id, t)
), known AS (
  SELECT digest, min(id) AS licence_id FROM (
    SELECT id, sha256({_canonical_sql("t")}) AS digest FROM texts UNION ALL SELECT id, digest FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(h)})" for i, h in licences.DIGESTS)}) h(id, digest)
  ) GROUP BY digest
), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), l AS (SELECT doc_id, sha256({_canonical_sql("line", lines=False)}) AS digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '(?i){"|".join(licences.HINTS)}')
), n AS (SELECT doc_id, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notices FROM l JOIN known USING (digest) GROUP BY doc_id
), c AS (SELECT doc_id, sha256({_canonical_sql("t")}) AS canonical_sha256 FROM d)
SELECT c.doc_id, canonical_sha256, licence_id, coalesce(notices, '') AS notices FROM c LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN n ON n.doc_id = c.doc_id
"""


@register("op8_licences", LICENCES_SQL)
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@register(
    "op11_suffix_array_dedup",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)
), twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1
), hit AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS opens FROM w WHERE h IN (SELECT h FROM twice)
), runs AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS n FROM hit) GROUP BY r, n
), gaps AS (SELECT r, z AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 3000000000) AS z FROM (SELECT * FROM runs UNION ALL SELECT r, 0, 1 FROM d)
), kept AS (SELECT r, string_agg(hex(b[a:z - 1]), '' ORDER BY a) AS k FROM gaps JOIN d USING (r) GROUP BY r
), n AS (SELECT r, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
""",
)
def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.remove_repeated_bytes(table(spark, sf_dir, "documents"), length=400, first_stays=False)


def _share_sql(n: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v)::HUGEINT)::BIGINT"


@register(
    "op12_source_divergence",
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), o AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30
), l AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS total FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)
  LEFT JOIN (SELECT lang, source, count(*) AS total FROM o JOIN k USING (lang, term) GROUP BY ALL) s USING (lang, source)
), c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share_sql("coalesce(c.n, 0)", "g.total")} AS p, {_share_sql("k.c", "g.lang_total")} AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def _clusters_sql(rounds: int = 3) -> str:
    """The rounds one after another: a<i> assigns to the centroids c<i>, whose vectors' sums give c<i + 1>."""
    ctes = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c FROM v QUALIFY cluster < 16)",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS (SELECT r, vec_id, v, cluster, distance FROM (SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v CROSS JOIN c{i}) "
            "QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"
        )
        if i < rounds:
            ctes.append(
                f"s{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM (SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT cluster, v, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster)"
            )
            ctes.append(f"c{i + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))")
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    )


@register("op13_centroid_clustering", _clusters_sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, seed="1")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
