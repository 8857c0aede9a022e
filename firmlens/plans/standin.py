"""Catalogue tables derived from the star-schema tables, for the registered queries; and the same as SQL.

customer stands for companies, nation for cities and source names, orders for postings,
labels, source links and contacts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.operators import catalog as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    title = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "Summer Internship ").otherwise("Engineer "), "o_orderpriority")
    return o.select(F.col("o_custkey").alias("company_id"), title.alias("title"), F.col("o_orderstatus").alias("location"), F.lit(None).cast("string").alias("url"), (F.col("o_orderstatus") == "O").alias("is_active"), T.is_internship(title).alias("is_internship"), "o_orderdate")


JOBS = """jobs AS (SELECT o_custkey AS company_id, CASE WHEN o_orderkey % 9 = 0 THEN 'Summer Internship ' ELSE 'Engineer ' END || o_orderpriority AS title,
  o_orderstatus AS location, o_orderstatus = 'O' AS is_active, o_orderkey % 9 = 0 AS is_internship, o_orderdate FROM orders)"""


def contacts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    box = F.when(F.col("o_orderpriority") == "1-URGENT", "ik").when(F.col("o_orderpriority") == "2-HIGH", "info").otherwise(F.concat(F.lit("ad.soyad"), (F.col("o_orderkey") % 10).cast("string")))
    email = F.concat(box, F.lit("@c"), F.col("o_custkey").cast("string"), F.lit(".example.com"))
    df = o.select(F.col("o_custkey").alias("company_id"), F.lit(None).cast("string").alias("name"), email.alias("email"), F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.com/iletisim")).alias("source_url"))
    return df.distinct().withColumn("contact_type", T.email_class(F.col("email")))


CONTACTS = """contacts AS (SELECT DISTINCT o_custkey AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ik' WHEN '2-HIGH' THEN 'info' ELSE 'ad.soyad' || (o_orderkey % 10) END || '@c' || o_custkey || '.example.com' AS email,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'hr' WHEN '2-HIGH' THEN 'generic' ELSE 'personal' END AS contact_type, 'https://c' || o_custkey || '.example.com/iletisim' AS source_url FROM orders)"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.lit("domain").alias("dimension"), F.col("o_orderpriority").alias("label")).distinct()
    return a.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.lit("directory_sector").alias("dimension"), F.col("c_mktsegment").alias("label")))


LABELS = """company_labels AS (SELECT DISTINCT o_custkey AS company_id, 'domain' AS dimension, o_orderpriority AS label FROM orders
  UNION ALL SELECT c_custkey, 'directory_sector', c_mktsegment FROM customer)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("s"), (F.col("o_orderkey") % 7).cast("string")).alias("source_key"), "o_orderdate")
    return o.groupBy("company_id", "source_key").agg(F.min("o_orderdate").alias("first_seen")).withColumn("listed_url", F.concat(F.lit("https://"), "source_key", F.lit(".example.net/")))


LINKS = """links AS (SELECT o_custkey AS company_id, 's' || (o_orderkey % 7) AS source_key, min(o_orderdate) AS first_seen,
  'https://s' || (o_orderkey % 7) || '.example.net/' AS listed_url FROM orders GROUP BY o_custkey, o_orderkey % 7)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_nationkey < 5")
    key = F.col("n_nationkey")
    return n.select(F.concat(F.lit("s"), key.cast("string")).alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("kind"), (key % 2).cast("string")).alias("kind"), (key != 1).alias("enabled"), F.when(key == 2, "error").when(key == 3, "ok").alias("health"))


SOURCES = """sources AS (SELECT 's' || n_nationkey AS key, n_name AS name, 'kind' || (n_nationkey % 2) AS kind, n_nationkey <> 1 AS enabled,
  CASE n_nationkey WHEN 2 THEN 'error' WHEN 3 THEN 'ok' END AS health FROM nation WHERE n_nationkey < 5)"""


def companies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    site = F.concat(F.lit("c"), k.cast("string"), F.lit(".example.com"))
    null = F.lit(None)
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(  # nations are a fixed 25 rows
        k.alias("id"), F.col("c_name").alias("name"), T.normalize_name(F.col("c_name")).alias("name_norm"), F.when(k % 5 != 0, site).alias("domain"), F.col("n_name").alias("city"),
        F.when(k % 5 != 0, F.concat(F.lit("https://"), site, F.lit("/"))).alias("website"), F.when(k % 3 == 0, F.concat(F.lit("https://"), site, F.lit("/careers"))).alias("careers_url"),
        F.when(k % 4 == 0, "lever").alias("ats_provider"), F.when(k % 6 == 0, C.USER_STATUSES[0]).when(k % 6 == 1, C.USER_STATUSES[1]).alias("user_status"),
        null.cast("string").alias("summary"), null.cast("string").alias("size_bucket"), null.cast("string").alias("sector"), null.cast("string").alias("detect_status"),
    )
    counters = C.job_counters(jobs(spark, d)).withColumnRenamed("company_id", "id")
    mails = C.email_counters(contacts(spark, d)).withColumnRenamed("company_id", "id")
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("first_seen"))
    out = c.join(counters, "id", "left").join(mails, "id", "left").join(seen, "id", "left")
    return out.na.fill(0, ["open_jobs_count", "email_count", "hr_email_count"]).na.fill(False, ["has_internship"])


COMPANIES = """companies AS (SELECT c_custkey AS id, c_name AS name, replace(lower(c_name), '#', ' ') AS name_norm,
  CASE WHEN c_custkey % 5 <> 0 THEN 'c' || c_custkey || '.example.com' END AS domain, n_name AS city,
  CASE WHEN c_custkey % 5 <> 0 THEN 'https://c' || c_custkey || '.example.com/' END AS website,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://c' || c_custkey || '.example.com/careers' END AS careers_url,
  CASE WHEN c_custkey % 4 = 0 THEN 'lever' END AS ats_provider,
  CASE c_custkey % 6 WHEN 0 THEN 'listemde' WHEN 1 THEN 'yazdim' END AS user_status,
  COALESCE(j.n, 0) AS open_jobs_count, COALESCE(j.i, false) AS has_internship, COALESCE(m.n, 0) AS email_count, COALESCE(m.h, 0) AS hr_email_count, s.f AS first_seen
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT company_id, count(*) FILTER (WHERE is_active) AS n, bool_or(is_active AND is_internship) AS i FROM jobs GROUP BY company_id) j ON j.company_id = c_custkey
  LEFT JOIN (SELECT company_id, count(DISTINCT email) AS n, count(DISTINCT CASE WHEN contact_type = 'hr' THEN email END) AS h FROM contacts GROUP BY company_id) m ON m.company_id = c_custkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY o_custkey) s ON s.o_custkey = c_custkey)"""

WITH = f"WITH {JOBS}, {CONTACTS}, {LABELS}, {LINKS}, {SOURCES}, {COMPANIES} "
