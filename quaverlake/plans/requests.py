"""Queries on requests: parts stand for what is asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requests
from .registry import query, table

ASKED = """CASE p_partkey % 7 WHEN 0 THEN '{"clap": ' || p_size || '.5, "size": ' || p_size * 5 || ', "variety": true}' WHEN 1 THEN '{"genre": -1, "flow": "yes", "variety": 0, "dedup": "song"}'
WHEN 2 THEN '{"speed": 1, "clapp": 2, "size": 30}' WHEN 3 THEN '{"dedup": "artist"}' WHEN 4 THEN '[1]' WHEN 5 THEN '{"clap": "x"}' ELSE '{"bpm": null, "size": "many"}' END"""


@query("""SELECT p_partkey AS id, ['params must be an object', 'unknown param(s): clapp, speed', 'not a number', 'dedup must be one of song, title, file', 'size must be a number'][CASE p_partkey % 7 WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 6 THEN 5 END] AS error,
  CASE WHEN p_partkey % 7 = 0 THEN least(5, p_size + 0.5)::DOUBLE END AS clap, CASE WHEN p_partkey % 7 = 1 THEN 0::DOUBLE END AS genre, CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS variety,
  CASE WHEN p_partkey % 7 = 1 THEN 1 END AS flow, CASE WHEN p_partkey % 7 = 1 THEN 'song' END AS dedup, CASE WHEN p_partkey % 7 = 0 THEN greatest(20, least(150, p_size * 5))::INT END AS size FROM part""")
def checked_params(spark, sf_dir):
    checked = requests.checked_params(F.expr(ASKED))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), checked.alias("x")).select("id", *[f"x.{k}" for k in ("error", "clap", "genre", "variety", "flow", "dedup", "size")])


@query("""WITH f AS (SELECT p_partkey AS id, (p_partkey % 1000) / 1000.0::DOUBLE AS fit, 0.5::DOUBLE + (p_size % 5) / 64.0::DOUBLE AS line FROM part),
s AS (SELECT *, round_even(fit * 100, 0)::INT || '%' AS a, round_even(line * 100, 0)::INT || '%' AS b FROM f)
SELECT id, a AS share, CASE WHEN line - fit <= 0.02::DOUBLE THEN 'by a hair' WHEN line - fit <= 0.1::DOUBLE THEN 'by a little' ELSE 'by a long way' END AS gap,
  CASE WHEN a <> b THEN a || ' of a twin''s score; the cut-off is ' || b WHEN fit < line THEN 'just under the cut-off of ' || b ELSE 'right at the cut-off of ' || b END AS against,
  CASE WHEN fit >= 0.7::DOUBLE THEN 'agree strongly' WHEN fit >= 0.4::DOUBLE THEN 'agree somewhat' ELSE 'barely agree' END AS agreement FROM s""")
def fit_words(spark, sf_dir):
    fit, line = F.col("p_partkey") % 1000 / F.lit(1000.0), F.lit(0.5) + F.col("p_size") % 5 / F.lit(64.0)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), requests.share(fit).alias("share"), requests.gap_in_words(fit, line).alias("gap"), requests.against_line(fit, line).alias("against"), requests.agreement_in_words(fit).alias("agreement")
    )


@query("""WITH r AS (SELECT p_partkey AS id, p_size::INT AS n, CASE p_partkey % 5 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0::DOUBLE WHEN 2 THEN 1::DOUBLE WHEN 3 THEN NULL ELSE 0.3::DOUBLE END AS line FROM part),
f AS (SELECT *, CASE WHEN line IS NOT NULL AND n % 4 > 0 THEN greatest(1, ceil(n * ((n % 4) / 4.0::DOUBLE)))::INT END AS floor, CASE WHEN n % 3 = 0 THEN least(greatest(n * 3, n + 60), 400) ELSE n END::INT AS want FROM r)
SELECT id, line, want, floor, CASE WHEN floor IS NULL OR want <= n THEN floor ELSE least(want, floor + want - n) END::INT AS scaled FROM f""")
def request_clamps(spark, sf_dir):
    """Lines of requests, how many rows they fetch and how many they keep in any case."""
    n, k = F.col("p_size").cast("int"), F.col("p_partkey") % 5
    line = requests.fit_line(F.when(k == 0, "0.25").when(k == 1, "-3").when(k == 2, "7.5").when(k == 3, "nan").otherwise(""), 0.3)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), n.alias("n"), line.alias("line"))
    rows = rows.withColumn("want", requests.with_headroom(F.col("n"), F.col("n") % 3 == 0)).withColumn("floor", requests.floor_count(F.col("n"), F.col("n") % 4 / F.lit(4.0), F.col("line")))
    return rows.select("id", "line", "want", "floor", requests.scaled_floor(F.col("floor"), F.col("n"), F.col("want")).alias("scaled"))


@query("""WITH e AS (SELECT vec_id AS id, list_transform(embedding[1:(vec_id % 30 + 1)::INT], lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT id, v, unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS place FROM e),
s AS (SELECT *, greatest(0, least(floor(place * len(v))::INT - 5, len(v) - 10)) AS start FROM p)
SELECT id, place, list_concat(v[(start + 1)::INT:(start + 10)::INT], list_transform(range(greatest(0, 10 - len(v))), lambda x: 0::DOUBLE)) AS part FROM s""")
def value_windows(spark, sf_dir):
    """Three windows of ten values, padded where a vector has fewer."""
    v = F.transform(F.slice("embedding", 1, (F.col("vec_id") % 30 + 1).cast("int")), lambda x: x.cast("double"))
    cuts = F.array(*[F.struct(F.lit(p).alias("place"), requests.window_at(F.col("v"), 10, p).alias("part")) for p in (0.2, 0.5, 0.8)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v")).select("id", F.explode(cuts).alias("x")).select("id", "x.*")


@query("SELECT l_orderkey AS k, l_linenumber AS n, count(*) FILTER (WHERE l_quantity >= 20 AND l_discount * 100 < l_quantity * 0.5 AND l_tax * 100 > greatest(l_discount * 100, 1e-9) * 1.5) AS short FROM lineitem GROUP BY 1, 2")
def short_reads(spark, sf_dir):
    """Lines whose quantity stands for a claimed length, discount and tax for what two readers found."""
    claimed, got, second = (F.col(c).cast("double") * k for c, k in (("l_quantity", 1), ("l_discount", 100), ("l_tax", 100)))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), requests.short_read(claimed, got, second).alias("short"))
    return rows.groupBy("k", "n").agg(F.count_if("short").alias("short"))
