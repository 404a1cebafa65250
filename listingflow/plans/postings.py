"""A postings view derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("Software Engineer Intern", "Data Analyst Intern", "Mechanical Engineer Co-op", "Senior Hardware Engineer", "Marketing Associate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting per line item: its supplier is the company, its part gives role, season and requisition."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = line.join(table(spark, sf_dir, "supplier"), line["l_suppkey"] == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    number, part, tenant = F.col("l_linenumber"), F.col("l_partkey"), F.concat(F.lit("sup"), F.col("l_suppkey").cast("string"))
    source, requisition = F.concat(F.lit("src"), (number % 7).cast("string")), (part % 200).cast("string")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (part % 5 + 1).cast("int"))
    url = (
        F.when(number % 7 == 6, F.concat(F.lit("https://www.linkedin.com/jobs/view/role-"), (F.col("l_orderkey") + 100000).cast("string")))
        .when(part % 4 == 0, F.concat(F.lit("https://boards.greenhouse.io/"), tenant, F.lit("/jobs/"), requisition, F.lit("?utm_source="), source))
        .when(part % 4 == 1, F.concat(F.lit("https://"), tenant, F.lit(".wd"), (number % 5 + 1).cast("string"), F.lit(".myworkdayjobs.com/careers/job/x_JR-"), (part % 200 + 1000).cast("string")))
        .otherwise(F.concat(F.lit("https://www.careers."), tenant, F.lit(".com/Job/?ref=feed"), number.cast("string"), F.lit("&job="), requisition))
    )
    return rows.select(
        (F.col("l_orderkey") * 10 + number).alias("posting_id"),
        source.alias("source"),
        (number % 7).cast("int").alias("source_rank"),
        (F.col("l_orderkey") * 10 + number).alias("pos"),
        F.concat("s_name", F.when(number % 3 == 0, " Inc.").otherwise("")).alias("company"),
        F.concat(role, F.lit(" "), (part % 40).cast("string")).alias("title"),
        url.alias("apply_url"),
        F.col("n_name").alias("location"),
        F.when(part % 2 == 0, "Summer 2027").otherwise("Fall 2027").alias("season"),
        (number % 7 == 6).alias("indirect"),
        F.when(number == 5, F.concat(F.lit("u"), F.col("l_suppkey").cast("string"), F.lit("-"), (part % 50).cast("string"))).otherwise("").alias("posting_uuid"),
        F.when(part % 9 == 0, "Hardware").when(part % 9 == 1, "Software").alias("category"),
        (F.col("l_orderkey") % 20).cast("string").alias("digest_id"),
    )


# Fixed text shared by the SQL forms: the same view, and its keys built from the columns themselves.
POSTINGS_SQL = """
p AS (
  SELECT l_orderkey * 10 + l_linenumber AS posting_id, 'src' || (l_linenumber % 7) AS source, l_linenumber % 7 AS source_rank,
    l_orderkey * 10 + l_linenumber AS pos, s_name || CASE WHEN l_linenumber % 3 = 0 THEN ' Inc.' ELSE '' END AS company,
    CASE l_partkey % 5 WHEN 0 THEN 'Software Engineer Intern' WHEN 1 THEN 'Data Analyst Intern' WHEN 2 THEN 'Mechanical Engineer Co-op'
      WHEN 3 THEN 'Senior Hardware Engineer' ELSE 'Marketing Associate' END || ' ' || (l_partkey % 40) AS title,
    n_name AS location, CASE WHEN l_partkey % 2 = 0 THEN 'Summer 2027' ELSE 'Fall 2027' END AS season, l_linenumber % 7 = 6 AS indirect,
    CASE WHEN l_linenumber = 5 THEN 'u' || l_suppkey || '-' || (l_partkey % 50) ELSE '' END AS posting_uuid,
    CASE l_partkey % 9 WHEN 0 THEN 'Hardware' WHEN 1 THEN 'Software' END AS category, CAST(l_orderkey % 20 AS VARCHAR) AS digest_id,
    CASE WHEN l_linenumber % 7 = 6 THEN 'li:' || (l_orderkey + 100000)
      WHEN l_partkey % 4 = 0 THEN 'gh:sup' || l_suppkey || ':' || (l_partkey % 200)
      WHEN l_partkey % 4 = 1 THEN 'wd:sup' || l_suppkey || ':jr' || (l_partkey % 200 + 1000)
      ELSE 'url:careers.sup' || l_suppkey || '.com/job?job=' || (l_partkey % 200) END AS url_key,
    CASE WHEN l_linenumber % 7 = 6 THEN 'https://www.linkedin.com/jobs/view/role-' || (l_orderkey + 100000)
      WHEN l_partkey % 4 = 0 THEN 'https://boards.greenhouse.io/sup' || l_suppkey || '/jobs/' || (l_partkey % 200) || '?utm_source=src' || (l_linenumber % 7)
      WHEN l_partkey % 4 = 1 THEN 'https://sup' || l_suppkey || '.wd' || (l_linenumber % 5 + 1) || '.myworkdayjobs.com/careers/job/x_JR-' || (l_partkey % 200 + 1000)
      ELSE 'https://www.careers.sup' || l_suppkey || '.com/Job/?ref=feed' || l_linenumber || '&job=' || (l_partkey % 200) END AS apply_url,
    trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS company_norm,
    CASE l_partkey % 5 WHEN 0 THEN 'software engineer' WHEN 1 THEN 'data analyst' WHEN 2 THEN 'mechanical engineer co op'
      WHEN 3 THEN 'senior hardware engineer' ELSE 'marketing associate' END || ' ' || (l_partkey % 40) AS title_norm,
    CASE WHEN l_partkey % 5 < 3 THEN 'intern' ELSE 'newgrad' END AS level,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]', ' ', 'g'), '\\b(united|states|in|us|usa)\\b', '', 'g'), ' +', ' ', 'g')) AS place,
    CASE WHEN l_partkey % 2 = 0 THEN 'su2027' ELSE 'fa2027' END AS season_norm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
k AS (SELECT *, 'id:' || company_norm || '|' || title_norm || '|' || place || '|' || level || '|' || season_norm AS identity_key FROM p)
"""
