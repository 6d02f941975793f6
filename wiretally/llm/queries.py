"""One query per operator, over whole tables, and the SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import (
    centroids,
    chat,
    decontaminate,
    exact_dedup,
    fingerprints,
    interpolation,
    language,
    link_graph,
    mixing,
    near_dedup,
    pii,
    quality,
    resampling,
)
from wiretally.llm.storage import durable

#: Rows of an Arrow batch: long texts make batches large before rows do.
ARROW_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id"):
    """One of five parts that a document belongs to."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))
    found = durable(found, "fingerprints")
    found = fingerprints.with_near_counts(found, F.col("id") % 20 == 0)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_near",
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies",
        F.get("positions", F.lit(0)).alias("position"),
        F.get("positions", F.lit(1)).alias("second_position"),  # no document is taken more than twice
    ).orderBy("position", "doc_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.examples(talks.unionByName(tricky)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    judged = quality.site_posteriors(docs, model, F.col("source"), F.col("lang"))
    return judged.select(
        F.col("id").alias("doc_id"), "p_text", "p_host", "p_path", "p_good", "keep"
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.benchmark_overlaps(docs, benchmark)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), width=4, radius=4)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language.learned_samples(docs, fold() != 0)
    found = language.identified(docs.withColumn("key", F.struct("doc_id", (fold() == 0).alias("held_out"))), samples, "key")
    return found.select("id.doc_id", "id.held_out", "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = (
        F.when(fold() == 1, interpolation.SCORED)
        .when(fold() == 2, interpolation.HELD)
        .otherwise(interpolation.COUNTED)
    )
    found = interpolation.scored(table(spark, sf_dir, "documents"), role)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.col("role") == interpolation.SCORED).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


#: Action, host and path of the url rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS t(action, host, path)")
    return link_graph.judged_pages(table(spark, sf_dir, "pages"), rules)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count_of(no: int):
        return F.size(F.filter("base", lambda s: s["kind_no"] == no)).cast("long")

    counts = [count_of(no).alias(f"n_{kind}") for no, kind in enumerate(pii.KINDS)]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = resampling.importance_draw(docs, target)
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carried={"text_sha256": digest})
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    built = {
        "op1_document_fingerprints": op1_document_fingerprints,
        "op2_source_mixing": op2_source_mixing,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_language_id": op7_language_id,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_url_filter": op9_url_filter,
        "op10_personal_data": op10_personal_data,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_centroid_clustering": op13_centroid_clustering,
    }

    def prepared(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
            return build(spark, sf_dir)

        return run

    return {name: prepared(build) for name, build in built.items()}


_OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '') || ':' || md5(coalesce(text, ''))) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT *, CASE rank % 3 WHEN 1 THEN 5.0::double WHEN 2 THEN 2.0::double ELSE 1.0::double END AS weight,
    CASE rank % 3 WHEN 1 THEN 1.0::double WHEN 2 THEN 0.5::double ELSE 1.5::double END AS a,
    CASE rank % 3 WHEN 1 THEN 1.0::double WHEN 2 THEN 1.5::double ELSE 0.5::double END AS b,
    2.0::double * source_size AS most
  FROM (
    SELECT source, cast(sum(size) AS bigint) AS source_size,
      row_number() OVER (ORDER BY source IS NULL, source) AS rank
    FROM sizes GROUP BY source)),
shares AS (
  SELECT *, row_number() OVER upto AS nth,
    (1.5::double * sum(source_size) OVER () - coalesce(sum(most) OVER (
       ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::double))
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      AS share
  FROM sources WINDOW upto AS (ORDER BY most / weight, rank)),
targets AS (
  SELECT *, least(most, coalesce(weight * (
    SELECT arg_min(share, nth) FROM shares WHERE share * weight <= most), most)) AS target
  FROM shares),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.a, t.b,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::double AS middle
  FROM sizes AS s JOIN targets AS t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN target > middle AND source_size > 0
    THEN cast(ceil((target - middle) / source_size) AS int) ELSE 0 END AS copies,
    CASE WHEN target > 0 THEN middle / target * ((a + b) / 2) ELSE 0 END AS need,
    CASE WHEN target > 0 THEN (middle + source_size) / target * ((a + b) / 2) ELSE 0 END AS again
  FROM placed)
SELECT doc_id, size, source_size, target, cast(copies * size AS bigint) AS taken, copies,
  CASE WHEN copies = 0 THEN NULL WHEN need > 0
    THEN 2 * need / (a + sqrt(greatest(a * a + 2 * (b - a) * need, 0))) ELSE 0 END AS position,
  CASE WHEN copies < 2 THEN NULL WHEN again > 0
    THEN 2 * again / (a + sqrt(greatest(a * a + 2 * (b - a) * again, 0))) ELSE 0 END AS second_position
FROM counted"""


_OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, role = 'assistant' AS is_reply, row_number() OVER later AS from_end,
    3 + length(replace(replace(replace(replace(
      role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B'))
    + 1 + length(regexp_replace(text, '(\\*)(</?s>|\[/?INST\])', '\\\1\2', 'g')) + 5 AS chars
  FROM turns WINDOW later AS (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC)),
used AS (
  SELECT *, sum(CASE WHEN is_reply OR from_end = 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id ORDER BY from_end) AS times
  FROM written)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY from_end DESC)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE is_reply), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY from_end DESC) FILTER (WHERE is_reply), ''))
    AS loss_sha256,
  sum(chars * times)::bigint AS formatted_chars
FROM used GROUP BY conv_id"""


_OP11_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
words AS (
  SELECT kind, id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS kind, doc_id AS id, text FROM documents
    UNION ALL SELECT 't', item_id, text FROM benchmark)),
grams AS (
  SELECT kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram
  FROM words),
distinct_grams AS (
  SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)),
bucketed AS (
  SELECT gram, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: cast('0x' || h[i:i + 1] AS bigint))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_grams, crc),
counts AS (
  SELECT bucket, count(*) FILTER (WHERE kind = 's') AS s, count(*) FILTER (WHERE kind = 't') AS t
  FROM grams JOIN bucketed USING (gram) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::double * (sum(s) OVER () + 10000)::double
    / ((s + 1)::double * (sum(t) OVER () + 10000)::double))) AS gain
  FROM counts),
sums AS (
  SELECT row, count(*) AS n, sum(gain) AS total
  FROM grams JOIN bucketed USING (gram) JOIN gains USING (bucket) WHERE kind = 's' GROUP BY row),
scored AS (
  SELECT id, row, coalesce(n, 0) AS n_features, coalesce(cast(floor(total / n) AS bigint), 0) AS weight, len(w) AS n_words,
    cast(floor(-1000 * ln(-ln((cast('0x' || sha256('7:' || coalesce(cast(id AS varchar), ''))[1:8] AS bigint) + 0.5::double)
      / 4294967296::double))) AS bigint) AS noise
  FROM words LEFT JOIN sums USING (row) WHERE kind = 's'),
placed AS (
  SELECT *, n_words >= 20 AS fits, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, id) AS place,
    count(*) FILTER (WHERE n_words >= 20) OVER () AS n
  FROM scored)
SELECT id AS doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN fits AND place <= 25 * n // 100 THEN place END AS rank
FROM placed"""


_OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _op13_sql(rounds: int = 3) -> str:
    """The rounds one after another, each an assignment over all pairs and a mean."""

    def assignment(centroids: str) -> str:
        return f"""
  SELECT vec_id, min_by(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, c, cast(sum((x - m) * (x - m)) AS bigint) AS d
    FROM cells JOIN {centroids} USING (dim) GROUP BY vec_id, c) GROUP BY vec_id"""

    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED ({assignment(f"centroid{k - 1}")}),
means{k} AS (
  SELECT c, dim, cast(floor(sum(x)::double / count(*)) AS bigint) AS m
  FROM near{k} JOIN cells USING (vec_id) GROUP BY c, dim),
centroid{k} AS MATERIALIZED (
  SELECT c, dim, coalesce(n.m, o.m) AS m FROM centroid{k - 1} AS o LEFT JOIN means{k} AS n USING (c, dim)),""")
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) AS bigint)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS dim, unnest(v) AS x FROM kept),
centroid0 AS MATERIALIZED (
  SELECT c, dim, x AS m FROM cells JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept
    QUALIFY c < 16) USING (vec_id)),{"".join(steps)}
last AS MATERIALIZED ({assignment(f"centroid{rounds}")}),
digests AS (
  SELECT c, sha256(string_agg(cast(m AS varchar), ',' ORDER BY dim)) AS centroid_sha256
  FROM centroid{rounds} GROUP BY c)
SELECT vec_id, cast(c AS int) AS cluster, d AS distance,
  cast(sum(d) OVER (PARTITION BY c) AS bigint) AS cluster_inertia, cast(sum(d) OVER () AS bigint) AS inertia,
  centroid_sha256
FROM last JOIN digests USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": _OP2_SQL,
        "op3_chat_formatting": _OP3_SQL,
        "op11_importance_resampling": _OP11_SQL,
        "op12_exact_dedup": _OP12_SQL,
        "op13_centroid_clustering": _op13_sql(),
    }
