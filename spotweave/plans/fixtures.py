"""The library's inputs, derived from the given tables: spots, counts, jobs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a task on average: its terms are many times that in memory, which partitions put together by the texts' size would spill.
TEXT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots of ``embeddings``: the first two components are the place, all are the features."""
    feat = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("spot_id"), feat[0].alias("x"), feat[1].alias("y"), feat.alias("feat"), (F.col("vec_id") % 3).alias("batch"),
        F.when(F.col("vec_id") % 17 != 0, F.concat(F.lit("L"), F.col("label").cast("string"))).alias("truth"), (F.col("vec_id") % 7).alias("pred"),
        F.expr("vec_id div 25").alias("array_row"), (F.col("vec_id") % 25).alias("array_col"),
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of ``documents`` as counts: a document is a spot, a term a gene."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("spot_id"), F.col("source").alias("slice"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = docs.repartition(max(2, -(-size // TEXT_BYTES)), "spot_id")  # texts are dealt by spot once: terms are counted and scaled where their text is, and none is sent
    terms = held.select("spot_id", "slice", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("gene"))
    return terms.groupBy("spot_id", "slice", "gene").agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def document_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("spot_id"), F.col("lang").alias("truth"), F.col("source").alias("slice"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of ``documents``: a method for each language, a slice for each source, three seeds."""
    docs = table(spark, sf_dir, "documents")
    part = docs.groupBy(F.col("lang").alias("method"), F.col("source").alias("slice"), (F.col("doc_id") % 3).cast("int").alias("seed"))
    share = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return part.agg(F.count(F.lit(1)).cast("double").alias("time"), F.avg(share).alias("ARI"), F.max(share).alias("NMI"), F.min(share).alias("FMS"))


#: The same inputs in DuckDB's SQL, as common table expressions.
SPOTS = """spots AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS feat, vec_id % 3 AS batch,
  CASE WHEN vec_id % 17 <> 0 THEN 'L' || CAST(label AS VARCHAR) END AS truth, vec_id % 7 AS pred, vec_id // 25 AS array_row, vec_id % 25 AS array_col FROM embeddings)"""
COUNTS = """counts AS (SELECT doc_id AS spot_id, source AS slice, gene, CAST(count(*) AS DOUBLE) AS cnt
  FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS gene FROM documents) GROUP BY 1, 2, 3)"""
RUNS = """runs AS (SELECT lang AS method, source AS slice, CAST(doc_id % 3 AS INTEGER) AS seed, CAST(count(*) AS DOUBLE) AS time, avg(n_chars / (n_chars + 1000.0)) AS ARI,
  max(n_chars / (n_chars + 1000.0)) AS NMI, min(n_chars / (n_chars + 1000.0)) AS FMS FROM documents GROUP BY 1, 2, 3)"""


def near(k: int, x: str = "x", y: str = "y", include_self: bool = False, name: str = "near") -> str:
    d2 = f"(a.{x} - b.{x}) * (a.{x} - b.{x}) + (a.{y} - b.{y}) * (a.{y} - b.{y})"
    on = "true" if include_self else "a.i <> b.i"
    return f"{name} AS (SELECT * FROM (SELECT a.i, b.i AS j, {d2} AS d2, row_number() OVER (PARTITION BY a.i ORDER BY {d2}, b.i) AS rank FROM spots a JOIN spots b ON {on}) WHERE rank <= {k})"


def near_feat(k: int, include_self: bool = True, name: str = "near") -> str:
    d2 = "list_sum(list_transform(list_zip(a.feat, b.feat), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    on = "true" if include_self else "a.i <> b.i"
    return f"{name} AS (SELECT i, j, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM (SELECT a.i, b.i AS j, {d2} AS d2 FROM spots a JOIN spots b ON {on})) WHERE rank <= {k})"


EDGES = "edges AS (SELECT i, j FROM near UNION SELECT j, i FROM near)"
UNIT = "unit AS (SELECT i, list_transform(f, lambda v: v / (sqrt(list_sum(list_transform(f, lambda u: u * u))) + 1e-8)) AS u FROM (SELECT i, feat[3:32] AS f FROM spots))"
WEIGHTS = """dist AS (SELECT e.i, e.j, 1 - list_inner_product(a.u, b.u) AS d FROM edges e JOIN unit a ON a.i = e.i JOIN unit b ON b.i = e.j),
tau AS (SELECT median(d) + 1e-8 AS tau FROM dist),
weights AS (SELECT i, j, greatest(0.05, least(1.0, exp(-d / tau))) AS w FROM dist, tau)"""
ADJ = """filled AS (SELECT i, j, w FROM weights UNION ALL SELECT i, i, 1.0 FROM spots),
deg AS (SELECT i, 1 / sqrt(greatest(sum(w), 1e-12)) AS s FROM filled GROUP BY i),
adj AS (SELECT f.i, f.j, a.s * f.w * b.s AS v FROM filled f JOIN deg a ON a.i = f.i JOIN deg b ON b.i = f.j)"""
GRAPH = f"{SPOTS}, {near(6)}, {EDGES}, {UNIT}, {WEIGHTS}"
