"""Registered queries of fields, filters, feeds, ledgers and pages: inputs are written out from the tables in the forms
that the operators read, and the SQL says what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, ledger, pages, rules
from ..operators.components import checkpoint_folder, checkpointed
from ..sources import feeds
from ..sources.markdown import parse_md_tables
from ..streaming.digest import catch_up, dry_run
from .postings import POSTINGS_SQL, postings_view, table
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/feed-{uuid.uuid4()}"


def _said(*parts: Column | str) -> Column:
    """Columns, and other parts as they are, one after the other."""
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


@query("""SELECT p_partkey, p_name || ' ' || p_brand || ' & <' || p_size || '>' AS cell, p_name || p_brand || ' "x"' AS card, p_name AS trimmed, p_type AS place,
CASE WHEN p_partkey % 3 = 0 THEN 'unknown date' WHEN p_partkey % 3 = 1 THEN p_name ELSE '2026-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS day,
p_size || CASE WHEN p_size = 1 THEN ' new listing' ELSE ' new listings' END || CASE WHEN p_partkey % 4 > 0 THEN ' (+' || (p_partkey % 4) || ' maybe)' ELSE '' END || CASE WHEN p_partkey % 5 > 1 THEN ' (1/' || (p_partkey % 5) || ')' ELSE '' END AS subject,
CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '$' || p_size || '/hr' ELSE '$' || p_size || ' - $' || format('{:,}', 1000 + p_size) || '/mo' END AS salary, len(string_split(p_name, ' ')) + 1 AS cells FROM part""")
def field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    stamp = F.when(key % 3 == 0, "").when(key % 3 == 1, F.col("p_name")).otherwise(_said("2026-01-", F.lpad((key % 28 + 1).cast("string"), 2, "0"), "T10:00:00"))
    low, high = F.when(key % 3 > 0, size.cast("double")), F.when(key % 3 == 2, size.cast("double") + 1000.0)
    return p.select(
        "p_partkey",
        X.cell_text(_said(" [", F.col("p_name"), "](https://x.org/", key.cast("string"), ")<br> ", F.col("p_brand"), "\n&amp; &lt;", size.cast("string"), "&gt;")).alias("cell"),
        X.card_text(_said(" <b>", F.col("p_name"), "</b>", F.col("p_brand"), " &#34;x&#34; ")).alias("card"),
        X.clean(_said(" \t", F.col("p_name"), " \n")).alias("trimmed"),
        X.short_location(_said(F.col("p_type"), " +", size.cast("string"), " more")).alias("place"),
        X.iso_day(stamp).alias("day"),
        X.subject_line(size, key % 4, F.lit(1), (key % 5).cast("int")).alias("subject"),
        X.format_salary(low, high, F.when(key % 3 == 1, 1).otherwise(3)).alias("salary"),
        F.size(X.split_row(_said("| ", F.replace(F.col("p_name"), F.lit(" "), F.lit(" | ")), " | |"))).cast("long").alias("cells"),
    )


@query("SELECT event_id, strftime(ts - INTERVAL 7 HOUR, '%a %b %d, %H:%M') AS label FROM events")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.run_label(F.col("ts"), "America/Phoenix").alias("label"))


@query("""WITH c AS (SELECT *, ['', ' ', 'N/A', 'tbd', 'Remote', '?', 'x'][c_custkey % 7 + 1] AS note FROM customer)
SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 = 0 AS open, c_custkey % 7 NOT IN (0, 1) AS complete, c_custkey % 7 IN (4, 6) AS meaningful, c_custkey % 5 = 0 AS aggregator,
c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 4 IN (1, 2) AS profiled, c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_mktsegment <> 'HOUSEHOLD' AS category FROM c""")
def field_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    note = F.element_at(F.array(*map(F.lit, ("", " ", "N/A", "tbd", "Remote", "?", "x"))), (key % 7 + 1).cast("int"))
    c = c.withColumns({"active": key % 2 == 0, "is_visible": F.when(key % 3 > 0, False).when(key % 6 == 3, F.lit(None).cast("boolean")).otherwise(True), "tags": F.array((key % 4).cast("int"), F.lit(9)), "note": note})
    url = F.when(key % 5 == 0, "https://www.LinkedIn.com/jobs/1").otherwise("https://linked.example/jobs")
    open_ = rules.is_open(c.select("c_custkey", "active", "is_visible")).select("c_custkey", F.lit(True).alias("open"))
    profile = rules.profile_filter(c, {"c_mktsegment": ["BUILDING", "MACHINERY"], "tags": [1, 2], "note": []})
    rows = c.select("c_custkey", rules.is_complete(F.lit("x"), F.col("note")).alias("complete"), rules.is_meaningful(F.col("note")).alias("meaningful"), rules.is_aggregator(url, ("linkedin.com",)).alias("aggregator"), profile.alias("profiled"), rules.category_ok(F.col("c_mktsegment"), ("HOUSEHOLD",), ("BUILDING", "HOUSEHOLD")).alias("category"))
    return rows.join(open_, "c_custkey", "left").fillna(False, ["open"])


@query("""WITH k(k, title, company, url, action, rule, allowed) AS (VALUES
(0, 'Summer of Code Intern', 'A', 'https://x.org/1', 'drop', 'block_title', false), (1, 'Data Intern', 'Jobright.ai', 'https://x.org/2', 'drop', 'block_company', true), (2, 'Web Intern', 'A', 'https://fellowship.mlh.io/3', 'drop', 'block_url', true),
(3, 'Unpaid Software Intern', 'A', 'https://x.org/4', 'drop', 'restrict_title', true), (4, 'Tax Intern', 'A', 'https://x.org/5', 'drop', 'maybe_title', false), (5, 'Tax Software Intern', 'A', 'https://x.org/6', 'keep', 'maybe_title', true), (6, 'Engineering Intern', 'A', 'https://x.org/7', 'keep', '', false))
SELECT o_orderkey, action, rule, CASE WHEN k = 5 THEN 1 ELSE 0 END AS rescued, CASE WHEN k IN (0, 1, 2) THEN 'drop' WHEN k IN (3, 4) THEN 'maybe' ELSE 'keep' END AS soft, 'keep' AS off,
[1, 1, 1, 2, 1, 2, 0][k + 1] AS n_rules FROM orders JOIN k ON o_orderkey % 7 = k""")
def rule_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    kind = (F.col("o_orderkey") % 7 + 1).cast("int")
    titles = ("Summer of Code Intern", "Data Intern", "Web Intern", "Unpaid Software Intern", "Tax Intern", "Tax Software Intern", "Engineering Intern")
    company = F.when(kind == 2, "Jobright.ai").otherwise("A")
    url = F.when(kind == 3, "https://fellowship.mlh.io/3").otherwise("https://x.org/1")
    p = o.select("o_orderkey", F.col("o_orderkey").alias("posting_id"), F.element_at(F.array(*map(F.lit, titles)), kind).alias("title"), company.alias("company"), url.alias("apply_url"), F.lit(None).cast("string").alias("category"))
    counts = rules.match_all_rules(p).groupBy("posting_id").agg(F.count("*").alias("n_rules")).withColumnRenamed("posting_id", "o_orderkey")
    hard = rules.judge(p, mode="drop").select("o_orderkey", "title", "company", "apply_url", "category", F.col("verdict.action").alias("action"), F.col("verdict.rule").alias("rule"), F.col("verdict.rescued").cast("int").alias("rescued"))
    soft = rules.judge(hard, mode="maybe").withColumn("soft", F.col("verdict.action")).drop("verdict")
    off = rules.judge(soft, mode="off").withColumn("off", F.col("verdict.action"))
    return off.join(counts, "o_orderkey", "left").select("o_orderkey", "action", "rule", "rescued", "soft", "off", F.coalesce("n_rules", F.lit(0)).cast("int").alias("n_rules"))


@query("SELECT DISTINCT p_type AS category FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")
def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unknown_categories(table(spark, sf_dir, "part").select(F.col("p_type").alias("category")), ["ECONOMY"], ["PROMO"])


# Ledgers: orders of even keys are stored, those of keys divisible by three come in.
_APPLIED = "applied_at, url, company, title"


def _records(df: DataFrame, mark: str) -> DataFrame:
    return df.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("applied_at"), F.concat(F.lit(f"{mark}u"), F.first(F.col("o_custkey")).cast("string")).alias("url"), F.when(F.first("o_custkey") % 2 == 0, "").otherwise(mark).alias("company"), F.lit(mark).alias("title"))


def _applied_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return _records(o.where("o_orderkey % 2 = 0"), "a"), _records(o.where("o_orderkey % 3 = 0"), "b")


_APPLIED_SQL = """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS key, strftime(min(o_orderdate), '%Y-%m-%d') AS applied_at, 'au' || o_custkey AS url, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'a' END AS company, 'a' AS title FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey),
b AS (SELECT CAST(o_custkey AS VARCHAR) AS key, strftime(min(o_orderdate), '%Y-%m-%d') AS applied_at, 'bu' || o_custkey AS url, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'b' END AS company, 'b' AS title FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
"""


@query(_APPLIED_SQL + """SELECT coalesce(b.key, a.key) AS key, coalesce(b.applied_at, a.applied_at) AS applied_at, coalesce(b.url, a.url) AS url, coalesce(b.company, a.company) AS company, coalesce(b.title, a.title) AS title FROM a FULL JOIN b ON a.key = b.key""")
def merged_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, incoming = _applied_tables(spark, sf_dir)
    path = _folder(spark)
    ledger.write_applied(base, path)
    return ledger.merge_applied(ledger.read_applied(spark, path), incoming).select("key", "applied_at", "url", "company", "title")


@query("""WITH RECURSIVE a AS (SELECT 'c' || o_custkey AS key, strftime(min(o_orderdate), '%Y-%m-%d') AS applied_at, 'au' || o_custkey AS url, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'a' END AS company, 'a' AS title FROM orders WHERE o_orderkey % 8 = 0 GROUP BY o_custkey),
m AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS m, 'D' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS stamp, ['c' || o_custkey, 'u' || (o_orderkey % 700), 'c' || (o_custkey + 7)] AS keys, 'mu' || o_orderkey AS url,
  CASE WHEN o_orderkey % 4 = 1 THEN 'm' || o_orderkey ELSE '' END AS company, CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_orderkey ELSE '' END AS title FROM orders WHERE o_orderkey % 2 = 1),
t AS (SELECT m, place, keys[place] AS key, lag(m) OVER (PARTITION BY keys[place] ORDER BY m) AS before FROM m, (VALUES (1), (2), (3)) AS v(place)),
l AS (SELECT m, arg_min(coalesce('m' || before, 'k' || a.key), place) AS up FROM t LEFT JOIN a ON t.key = a.key WHERE before IS NOT NULL OR a.key IS NOT NULL GROUP BY m),
r(m, root) AS (SELECT m.m, coalesce(up, 'm' || m.m) FROM m LEFT JOIN l ON l.m = m.m WHERE up IS NULL OR up LIKE 'k%' UNION ALL SELECT l.m, r.root FROM r JOIN l ON l.up = 'm' || r.m),
s AS (SELECT root, m, stamp, url, company, title FROM r JOIN m USING (m) UNION ALL SELECT 'k' || key, 0, applied_at, url, company, title FROM a WHERE 'k' || key IN (SELECT root FROM r)),
f AS (SELECT root, arg_min(stamp, m) AS applied_at, arg_min(url, m) AS url, coalesce(arg_min(company, m) FILTER (company <> ''), '') AS company, coalesce(arg_min(title, m) FILTER (title <> ''), '') AS title FROM s GROUP BY root),
n AS (SELECT t.key, max(m) AS m FROM t GROUP BY t.key),
w AS (SELECT key, applied_at, url, company, title FROM n JOIN r USING (m) JOIN f USING (root) UNION ALL SELECT * FROM a WHERE key NOT IN (SELECT key FROM n))
SELECT key, applied_at, url, company, title FROM w WHERE CAST(substr(key, 2) AS INTEGER) % 10 <> 0""")
def marked_and_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of three keys each, in order of the order key, on a ledger of customers; then every tenth key is unmarked."""
    o, n, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    held = o.where("o_orderkey % 8 = 0").groupBy("o_custkey").agg(F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("applied_at"))
    base = held.select(_said("c", c.cast("string")).alias("key"), "applied_at", _said("au", c.cast("string")).alias("url"), F.when(c % 2 == 0, "").otherwise("a").alias("company"), F.lit("a").alias("title"))
    keys = F.array(_said("c", c.cast("string")), _said("u", (n % 700).cast("string")), _said("c", (c + 7).cast("string")))
    told = (F.when(test, _said(letter, n.cast("string"))).otherwise("").alias(name) for test, letter, name in ((n % 4 == 1, "m", "company"), (n % 3 == 0, "t", "title")))
    marks = o.where("o_orderkey % 2 = 1").select(keys.alias("keys"), _said("D", F.lpad(n.cast("string"), 12, "0")).alias("applied_at"), _said("mu", n.cast("string")).alias("url"), *told)
    marked = checkpointed(ledger.mark_applied(base, marks))
    return ledger.unmark_applied(marked, marked.where("cast(substring(key, 2) AS int) % 10 = 0").select("key")).select("key", "applied_at", "url", "company", "title")


@query(_APPLIED_SQL + """SELECT CASE WHEN key = (SELECT min(key) FROM a) THEN '{' ELSE ',' END || '"' || key || '":{"applied_at":"' || applied_at || '","url":"' || url || '","company":"' || company || '","title":"' || title || '"}' || CASE WHEN key = (SELECT max(key) FROM a) THEN '}' ELSE '' END AS value FROM a""")
def exported_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.export_applied(_applied_tables(spark, sf_dir)[0])


@query("""WITH s AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 5 = 0)
SELECT c_custkey AS cluster_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT key FROM s) AND CAST(c_custkey + 1 AS VARCHAR) NOT IN (SELECT key FROM s)""")
def new_by_older_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that neither their key nor an older key, which a ledger written and read again holds, shows as seen."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    clusters = c.select(F.col("c_custkey").alias("cluster_id"), F.array(F.col("c_custkey").cast("string")).alias("keys"))
    older = c.select(F.col("c_custkey").alias("cluster_id"), F.array((F.col("c_custkey") + 1).cast("string")).alias("legacy_keys"))
    path = _folder(spark)
    seen = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("key")).distinct().withColumn("first_seen", F.lit("2026-01-01T00:00:00"))
    ledger.write_ledger(seen, path)
    return ledger.new_only(clusters, ledger.read_ledger(spark, path)[0], older).select("cluster_id")


@query("""SELECT CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 5 = 4 THEN 'FAIL' WHEN o_orderkey % 5 IN (1, 2) THEN 'BLOCKED' WHEN o_orderkey % 5 = 3 THEN 'FAIL' ELSE 'OK' END AS result, count(*) AS n FROM orders GROUP BY 1""")
def link_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    url = F.when(key % 6 == 0, "https://www.linkedin.com/jobs/view/1").otherwise("https://a.org")
    code = F.element_at(F.array(*map(F.lit, ("200", "403", "429", "404", "timeout"))), (key % 5 + 1).cast("int"))
    return audit.link_summary(table(spark, sf_dir, "orders").select(url.alias("url"), code.alias("code")))


@query(f"WITH {POSTINGS_SQL} SELECT posting_id, CASE WHEN posting_uuid LIKE '%-7' THEN 'https://boards.greenhouse.io/t/jobs/' || posting_uuid ELSE apply_url END AS apply_url FROM p")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings_view(spark, sf_dir)
    targets = p.where("posting_uuid LIKE '%-7'").select(F.col("posting_uuid").alias("id"), _said("https://boards.greenhouse.io/t/jobs/", F.col("posting_uuid")).alias("target"))
    return ledger.resolve_links(p, targets).select("posting_id", "apply_url")


def _alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings_view(spark, sf_dir)
    return p.select(F.col("posting_id").alias("cluster_id"), F.struct("posting_id", "source", "company", "title", "apply_url", "indirect", F.col("pos").alias("ord")).alias("rep"))


@query(f"""WITH {POSTINGS_SQL}, r AS (SELECT posting_id, row_number() OVER (ORDER BY indirect, lower(company), lower(title), pos) AS rank FROM p)
SELECT posting_id AS cluster_id, posting_id, CAST(rank AS INTEGER) AS rank, CAST((rank - 1) // 150 AS INTEGER) AS batch_no FROM r""")
def catch_up_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catch_up(_alone(spark, sf_dir))


@query(f"WITH {POSTINGS_SQL} SELECT posting_id AS cluster_id, source, company, title, apply_url, indirect FROM p")
def dry_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dry_run(_alone(spark, sf_dir))


# Feeds, written out in the form in which they land.
@query("""SELECT n, source, source_rank, company, title, apply_url, location, season, posted, posting_uuid, category FROM (SELECT o_orderkey AS n, 'feed' AS source, 2 AS source_rank, 'C' || o_custkey AS company, 'Intern ' || o_orderkey AS title, 'https://x.org/' || o_orderkey AS apply_url,
CASE WHEN o_orderkey % 3 = 0 THEN 'London, UK, Austin, TX' ELSE 'Austin, TX' END AS location, 'Summer 2027' AS season, strftime(o_orderdate, '%b %d') AS posted, 'u' || o_orderkey AS posting_uuid, o_orderstatus AS category
FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 1 AND o_orderstatus <> 'F')""")
def feed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key, path = table(spark, sf_dir, "orders"), F.col("o_orderkey"), _folder(spark)
    place = F.when(key % 3 == 0, F.array(F.lit("London, UK"), F.lit("Austin, TX"))).when(key % 3 == 1, F.array(F.lit("Paris, France"))).otherwise(F.array(F.lit("Austin, TX")))
    terms = F.when(key % 4 == 0, F.array(F.lit("Fall 2025"))).otherwise(F.array(F.lit("Summer 2027"), F.lit("N/A")))
    rows = o.select((key % 7 != 0).alias("active"), F.lit(True).alias("is_visible"), F.col("o_orderstatus").alias("category"), terms.alias("terms"), place.alias("locations"), _said(" https://x.org/", key.cast("string")).alias("url"), _said("C", F.col("o_custkey").cast("string")).alias("company_name"), _said("Intern ", key.cast("string"), " ").alias("title"), _said("u", key.cast("string")).alias("id"), F.unix_timestamp("o_orderdate").alias("date_posted"))
    lists = rows.withColumn("file", F.floor(F.regexp_extract("url", r"(\d+)$", 1).cast("long") / 1000)).select("file", F.to_json(F.struct("active", "is_visible", "category", "terms", "locations", "url", "company_name", "title", "id", "date_posted")).alias("j"))
    lists.groupBy("file").agg(_said("[", F.array_join(F.collect_list("j"), ",\n"), "]").alias("value")).write.partitionBy("file").text(path)
    feed = feeds.read_feed(spark, path, "feed", 2, ("2027",), ("F",))
    return feed.select(F.regexp_extract("apply_url", r"(\d+)$", 1).cast("long").alias("n"), "source", "source_rank", "company", "title", "apply_url", "location", "season", "posted", "posting_uuid", "category")


@query("""WITH g AS (SELECT 'f' || (c_nationkey % 5) AS source, count(*) AS n FROM customer WHERE c_nationkey % 5 <> 2 GROUP BY 1)
SELECT source, CAST(substr(source, 2) AS INTEGER) AS source_rank, 1 AS ok, n, '' AS error FROM g UNION ALL SELECT 'f2', 2, 0, 0, 'a file is no JSON list' UNION ALL SELECT 'gone', 5, 0, 0, 'no file'""")
def feeds_in_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by source of five feeds of several files, of which one is cut off in one file, and of one that isn't there."""
    c, path = table(spark, sf_dir, "customer"), _folder(spark)
    key, feed = F.col("c_custkey").cast("string"), _said("f", (F.col("c_nationkey") % 5).cast("string"))
    record = F.to_json(F.struct(F.lit(True).alias("active"), F.lit(True).alias("is_visible"), F.lit("SWE").alias("category"), F.array(F.lit("Summer 2027")).alias("terms"), F.array(F.lit("Austin, TX")).alias("locations"), _said("https://x.org/", key).alias("url"), _said("C", key).alias("company_name"), _said("Intern ", key).alias("title"), key.alias("id"), F.lit(86400).alias("date_posted")))
    lists = c.select(feed.alias("feed"), F.floor(F.col("c_nationkey") / 5).alias("file"), record.alias("j")).groupBy("feed", "file").agg(F.array_join(F.collect_list("j"), ",\n").alias("body"))
    cut = (F.col("feed") == "f2") & (F.col("file") == 1)
    lists.select("feed", "file", F.when(cut, _said("[", F.col("body"))).otherwise(_said("[", F.col("body"), "]")).alias("value")).repartition("feed", "file").drop("file").write.option("maxRecordsPerFile", 1).partitionBy("feed").text(path)
    postings, runs = feeds.read_feeds(spark, [*((f"f{k}", f"{path}/feed=f{k}") for k in range(5)), ("gone", f"{path}/feed=gone")])
    counts = postings.groupBy("source").agg(F.count("*").alias("n"))
    return runs.join(counts, "source", "left").select("source", "source_rank", F.col("ok").cast("int").alias("ok"), F.coalesce("n", F.lit(0)).alias("n"), "error")


@query("""WITH h AS (SELECT c_custkey, c_custkey // 2 AS id, row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey) AS turn FROM customer)
SELECT 'c' || id AS posting_uuid, 'Company ' || c_custkey AS company, 'Role ' || c_custkey AS title, 'A, B' AS location, 'Summer' AS season, '$' || (c_custkey % 90 + 10) || '/hr' AS salary, 'Jan 02' AS posted, 'index' AS source FROM h WHERE turn = 1""")
def index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    amount = (key % 90 + 10).cast("double")
    doc = F.struct(_said("c", F.floor(key / 2).cast("string")).alias("id"), _said("Company ", key.cast("string")).alias("company_name"), _said("Role ", key.cast("string")).alias("title"), F.array(*map(F.lit, "ABC")).alias("locations"), F.array(F.lit("Summer")).alias("seasons"), amount.alias("min_salary"), amount.alias("max_salary"), F.lit(1).alias("salary_period"), F.lit(86400).alias("start_date"))
    page = table(spark, sf_dir, "customer").select(F.floor(key / 50).alias("page"), "c_custkey", F.struct(doc.alias("document")).alias("hit"))
    body = page.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "hit"))), lambda x: x["hit"]).alias("hits"))  # 50 hits a page
    hits = feeds.read_index_hits(body.select(F.lit(0).alias("profile_rank"), "page", F.to_json(F.struct(F.size("hits").alias("found"), "hits")).alias("body")))
    return hits.select("posting_uuid", "company", "title", "location", "season", "salary", "posted", "source")


@query("""SELECT o_orderkey AS page_no, 'https://www.linkedin.com/jobs/view/role-' || o_orderkey AS apply_url, 'Role & ' || o_orderpriority AS title, 'Co ' || o_custkey AS company, 'Austin, TX' AS location, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders WHERE o_orderkey % 5 <> 0""")
def card_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(_said('<h3 class="x base-search-card__title">\n Role &amp; ', F.col("o_orderpriority"), " </h3>"))
    card = _said('<ul><li>\n<a href="https://www.linkedin.com/jobs/view/role-', key, '?pos=1">', title, '<h4 class="base-search-card__subtitle"> <a href="#">Co ', F.col("o_custkey").cast("string"), '</a></h4><span class="job-search-card__location"> Austin, TX </span><time datetime="', F.date_format("o_orderdate", "yyyy-MM-dd"), '"></time></li><li>none</li></ul>')
    return feeds.parse_cards(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_no"), card.alias("html"))).select("page_no", "apply_url", "title", "company", "location", "posted")


@query(f"WITH {POSTINGS_SQL} SELECT source, company, title, apply_url, location, season, indirect, posting_uuid, category FROM p")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings_view(spark, sf_dir).withColumns({"salary": F.lit(""), "posted": F.lit("")})
    runs = p.select("source").distinct().withColumns({"ok": F.lit(True), "error": F.lit("")})
    path = _folder(spark)
    feeds.dump_corpus(p, runs, path)
    return feeds.load_corpus(spark, path).select("source", "company", "title", "apply_url", "location", "season", "indirect", "posting_uuid", "category")


@query("SELECT 'good' AS source, 0 AS source_rank, 1 AS ok, (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'missing', 1, 0, 0 UNION ALL SELECT 'broken', 2, 0, 0 UNION ALL SELECT 'later', 3, 1, (SELECT count(*) FROM nation)")
def isolated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name: str, of: str):
        return lambda: table(spark, sf_dir, name).select(F.col(of).alias("company"))

    broken = lambda: table(spark, sf_dir, "supplier").select(F.raise_error(F.lit("half-way")).cast("string").alias("company"))
    postings, runs = feeds.union_sources(spark, [("good", rows("supplier", "s_name")), ("missing", rows("no_such_table", "x")), ("broken", broken), ("later", rows("nation", "n_name"))])
    counts = postings.groupBy("source").agg(F.count("*").alias("n"))
    return runs.join(counts, "source", "left").select("source", "source_rank", F.col("ok").cast("int").alias("ok"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT 'd' || (c_custkey // 50) AS source, 'Co ' || (c_custkey - c_custkey // 25 % 3 * 25) AS company, 'Intern ' || c_custkey AS title, 'https://x.org/' || c_custkey AS apply_url, c_mktsegment AS location, '3d' AS posted FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey // 25 % 3 = 0
UNION ALL SELECT 'd' || (c_custkey // 50), 'Solo ' || c_custkey, 'Intern ' || c_custkey, 'https://x.org/' || c_custkey, c_mktsegment, '3d' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey // 25 % 3 > 0""")
def markdown_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per 50 customers: they are rows of a table; every other kind of row has a closed, carried or linked cell."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    own = F.floor(key / 25) % 3
    name = F.when(own == 0, _said("**Co ", key.cast("string"), "**")).otherwise(_said("[Solo ", key.cast("string"), "](https://co.org)"))
    name = F.regexp_replace(name, r"\*", "")
    apply = _said('<a href="https://i.imgur.com/x.png">x</a> <a href="https://x.org/', key.cast("string"), '">Apply</a>', F.when(key % 7 == 0, " 🔒").otherwise(""))
    line = _said("| ", name, " | Intern ", key.cast("string"), " | ", F.col("c_mktsegment"), " | ", apply, " | 3d |")
    skipped = _said("\n## Closed ones\n| Company | Role | Location | Application/Link | Age |\n|---|---|---|---|---|\n| X | Y | Z | [a](https://x.org/0) | 1d |\n")
    docs = c.groupBy(F.floor(key / 50).alias("doc")).agg(_said("# Jobs\n\n| Company | Role | Location | Application/Link | Age |\n|---|:--|---|---|---|\n", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "\n"), "\n", skipped).alias("text"))
    found, _ = parse_md_tables(docs.select(_said("d", F.col("doc").cast("string")).alias("source"), "text"), ("closed",))
    return found.select("source", "company", "title", "apply_url", "location", "posted")


# Pages, built from orders: a known host, structured data in a graph, an open-graph type, or an apply control with sections.
@query("""SELECT o_orderkey AS page_id, o_orderkey % 6 < 5 AS is_job, ['url', 'json-ld', 'json-ld', 'og', 'text', NULL][o_orderkey % 6 + 1] AS signal,
CASE o_orderkey % 6 WHEN 0 THEN 'gh:acme:' || o_orderkey WHEN 1 THEN 'job:id-' || o_orderkey WHEN 2 THEN 'gh:acme:' || o_orderkey WHEN 5 THEN NULL ELSE 'url:x.org/p/' || o_orderkey END AS key,
CASE o_orderkey % 6 WHEN 1 THEN 'Role ' || o_orderkey WHEN 5 THEN NULL ELSE 'Page ' || o_orderkey END AS title FROM orders""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    key = F.col("o_orderkey").cast("string")
    around = (F.floor(F.col("o_orderkey") / 6) % 11).cast("int")  # graphs around the graph
    graph = _said('<script type="application/ld+json">', F.repeat(F.lit('{"@graph":[{"@type":"WebSite"},['), around + 1), '{"@graph":[{"@type":["Thing","JobPosting"],"identifier":{"value":"ID-', key, '"},"title":"Role ', key, '"}]}', F.repeat(F.lit('], {"@type":"JobPosting","title":"after"}]}'), around + 1), "</script>")
    linked = _said('<script type="application/ld+json">[{"@type":"Person"},{"@type":"JobPosting","url":"https://boards.greenhouse.io/acme/jobs/', key, '"}]</script>')
    control = F.element_at(F.array(*map(F.lit, ("<button><b>Apply now</b></button>", '<input type="submit" value="Apply">', '<div role="button" aria-label="Submit application"></div>', "<a href='#'>Apply for this job</a>"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    html = F.when(k == 1, graph).when(k == 2, linked).when(k == 3, F.lit('<meta property="og:type" content="og:Job">')).when(k == 4, _said(control, "<p>Responsibilities</p><p>Qualifications</p>")).otherwise(_said("<p>Responsibilities: qualifications</p><script>apply now</script>"))
    url = F.when(k == 0, _said("https://boards.greenhouse.io/acme/jobs/", key)).otherwise(_said("https://x.org/p/", key))
    return pages.detect_job_pages(o.select(F.col("o_orderkey").alias("page_id"), url.alias("url"), _said("<title> Page ", key, " </title>", html).alias("html")))


@query("""SELECT c_custkey, ['gh', 'gh', 'lv', 'ab', 'wd', 'wd', 'goog', 'appl', 'meta', 'sr', 'gh', 'atj', 'rip', 'amzn', 'tt', 'jv', 'icims', 'wk', 'li', 'url'][c_custkey % 20 + 1] || ':' || CASE c_custkey % 20
WHEN 2 THEN 'acme:' || u WHEN 3 THEN 'acme:' || u WHEN 4 THEN 'acme:jr' || n WHEN 5 THEN 'acme:r' || n WHEN 10 THEN 'jid:' || n WHEN 12 THEN 'acme:' || u WHEN 17 THEN 'acme:ABC' || n WHEN 19 THEN 'x.org/a?id=' || n
WHEN 6 THEN n WHEN 7 THEN n WHEN 8 THEN n WHEN 13 THEN n WHEN 14 THEN n WHEN 18 THEN n ELSE 'acme:' || n END AS url_key
FROM (SELECT c_custkey, CAST(c_custkey + 1000000 AS VARCHAR) AS n, '00000000-0000-0000-0000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS u FROM customer)""")
def url_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import url_key

    return _shaped(spark, sf_dir).select("c_custkey", url_key("url").alias("url_key"))


@query("SELECT c_custkey, c_custkey % 20 <> 19 AS job_host FROM customer UNION ALL SELECT -1 - page_id, regexp_matches(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), 'jobs\\.|careers\\.|career\\.|\\.wd[0-9]|greenhouse|workday|icims') FROM pages")
def job_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a URL is of a host that serves postings: one of each known shape per customer, and those of the pages."""
    urls = _shaped(spark, sf_dir).unionByName(table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("c_custkey"), "url"))
    return urls.select("c_custkey", pages.is_job_host(F.col("url")).alias("job_host"))


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, url): the shape of a customer's URL is its key's remainder by twenty."""
    n, key = (F.col("c_custkey") + 1000000).cast("string"), (F.col("c_custkey") % 20).cast("int")
    u = _said("00000000-0000-0000-0000-", F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    shapes = [
        _said("https://boards.greenhouse.io/Acme/jobs/", n), _said("https://boards.greenhouse.io/embed/job_app?for=Acme&b=1&token=", n), _said("https://jobs.lever.co/Acme/", u, "/apply"), _said("https://jobs.ashbyhq.com/acme/", u),
        _said("https://acme.wd5.myworkdayjobs.com/en/x/Intern_JR-", n), _said("https://x.myworkdayjobs.com/wday/cxs/acme/job/Y_R_", n), _said("https://www.google.com/about/careers/applications/jobs/results/", n, "-x"), _said("https://jobs.apple.com/en-us/details/", n, "/x"),
        _said("https://www.metacareers.com/jobs/", n), _said("https://jobs.smartrecruiters.com/Acme/", n, "-x"), _said("https://x.org/careers?gh_jid=", n), _said("https://acme.applytojob.com/apply/", n), _said("https://ats.rippling.com/en/acme/jobs/", u),
        _said("https://www.amazon.jobs/en/jobs/", n), _said("https://lifeattiktok.com/search/", n), _said("https://jobs.jobvite.com/Acme/job/", n), _said("https://acme.icims.com/jobs/", n, "/x"), _said("https://apply.workable.com/acme/j/abc", n), _said("https://www.linkedin.com/jobs/view/intern-at-", n), _said("https://www.x.org/A/?utm_source=y&id=", n),
    ]
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*shapes), key).alias("url"))
