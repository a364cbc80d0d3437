"""Registered queries of the package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import packing, tokens

    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, tokens.default_path(), limit=1024, end_id=2, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import licenses

    return licenses.scanned(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import quality

    return quality.classified(table(spark, sf_dir, "documents"))


# fixed values of the contract: verdict, host, path
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import urlfilter

    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import knn

    return knn.top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import fingerprints

    return fingerprints.edit_robustness(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import tokenfiles, tokens
    from veilgrain.session import delete_at_exit, run_folder

    folder = run_folder(spark, "tokens")
    delete_at_exit(spark, folder)
    tokenfiles.write(table(spark, sf_dir, "documents"), folder, tokens.default_path(), end_id=0)
    return tokenfiles.documents(spark, folder)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import mixing

    return mixing.mixed(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share_percent=150, cap=2)


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import rollups, tokens

    return rollups.corpus_rollup(table(spark, sf_dir, "documents"), tokens.default_path(), "byte_bpe_50k", restore=True)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import resampling

    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import vectorcodes

    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgrain.llm import outliers

    return outliers.judged(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
banded AS (
  SELECT *, CAST(floor(ln(size + 1) * 11.541560327111707 + 1e-9) AS INTEGER) AS band,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM rows),
cut AS (
  SELECT *, ceil(count(*) OVER (PARTITION BY source, band)
    / greatest(256.0, floor(sqrt(count(*) OVER ())))) AS blocks
  FROM banded),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, h % CAST(blocks AS BIGINT), size, doc_id NULLS LAST)
    AS place
  FROM cut),
sizes AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS most, sum(source_size) OVER () * 150 / 100 AS total,
    CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sizes),
levels AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
held AS (
  SELECT *, first_value(CASE WHEN level * weight <= most THEN level END IGNORE NULLS) OVER (
    ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM levels),
shares AS (
  SELECT source, source_size, CASE WHEN stop IS NULL THEN most ELSE least(stop * weight, most) END AS target,
    CAST('0x' || substr(md5('mix|' || coalesce('=' || source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM held),
rated AS (
  SELECT p.doc_id, p.source, p.size, p.place, CAST(s.source_size AS BIGINT) AS source_size, s.target, s.shift,
    CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0::DOUBLE END AS rate
  FROM placed p JOIN shares s ON p.source IS NOT DISTINCT FROM s.source),
counted AS (
  SELECT *, CAST(floor(shift + place * rate) - floor(shift + (place - 1) * rate) AS BIGINT) AS copies FROM rated)
SELECT doc_id, source, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM counted
"""

OP6_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_QUERIES = (
    op1_best_fit_packing,
    op2_minhash_near_dedup,
    op3_license_scan,
    op4_quality_classifier,
    op5_url_filter,
    op6_exact_top_k,
    op7_document_fingerprints,
    op8_token_files,
    op9_source_mixing,
    op10_token_rollup,
    op11_importance_resampling,
    op12_vector_codes,
    op13_quality_rules,
)
QUERIES: dict[str, QueryFn] = {f.__name__: f for f in _QUERIES}


def _oracles() -> dict[str, str]:
    from veilgrain.llm import licenses, resampling, vectorcodes

    return {
        "op3_license_scan": licenses.oracle(),
        "op6_exact_top_k": OP6_SQL,
        "op9_source_mixing": OP9_SQL,
        "op11_importance_resampling": resampling.oracle(),
        "op12_vector_codes": vectorcodes.oracle(),
    }


ORACLES = _oracles()
