"""Registered queries of streams and of what is recorded after a delivery, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import strip_ambiguous
from ..operators.ledger import SEEN, keys_to_store
from ..schema import POSTINGS
from ..sources.markdown import parse_md_tables
from ..streaming.digest import commit_delivered, dedup_within, start
from .field_queries import _folder, _said
from .postings import table
from .registry import query

#: Files that a replay lands one after the other; the last lands again.
TURNS = 3


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting per line item, whose part is its job; `turn` is the file that it lands in."""
    line, part = table(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("string")
    place = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(1 << 43))  # order and line repeat
    said = {
        "posting_id": place, "source": F.lit("s0"), "source_rank": F.lit(0), "pos": place, "company": _said("Maker", part),
        "title": F.lit("Software Engineer Intern"), "apply_url": _said("https://boards.greenhouse.io/acme/jobs/", part), "location": F.lit("Austin, TX"), "season": F.lit("Summer 2027"), "salary": F.lit(""), "posted": F.lit(""),
        "indirect": F.lit(False), "posting_uuid": F.lit(""), "category": F.lit(None).cast("string"),
    }
    # parts come up one by one: a third of them in each file, and some again in later ones
    turn = F.when(F.col("l_orderkey") % 5 == 0, F.lit(TURNS - 1)).otherwise(F.col("l_partkey") % TURNS)
    return line.select(turn.cast("int").alias("turn"), *(c.alias(name) for name, c in said.items()))


@query(f"""WITH t AS (SELECT l_partkey, min(CASE WHEN l_orderkey % 5 = 0 THEN {TURNS - 1} ELSE l_partkey % {TURNS} END) AS first FROM lineitem GROUP BY l_partkey),
n AS (SELECT l_partkey, CASE WHEN l_orderkey % 5 = 0 THEN {TURNS - 1} ELSE l_partkey % {TURNS} END AS turn, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(first AS INTEGER) AS batch, t.l_partkey AS part, n AS n_members FROM t JOIN n ON n.l_partkey = t.l_partkey AND n.turn = first WHERE first > 0""")
def replayed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each micro-batch of a stream of landed files sends: the stream is stopped after every file and begun again
    from its checkpoint; the first batch only records, and the last file, which lands twice, sends nothing more."""
    feed, state, rows = _folder(spark), _folder(spark), _landed(spark, sf_dir)
    for turn in range(TURNS + 1):
        rows.where(F.col("turn") == min(turn, TURNS - 1)).drop("turn").write.mode("append").parquet(feed)
        run = start(spark.readStream.schema(POSTINGS).parquet(feed), state).trigger(availableNow=True).start()
        run.awaitTermination()
    batches = [f"{state}/batches/batch={turn}" for turn in range(TURNS + 1)]
    sent = spark.read.option("basePath", f"{state}/batches").parquet(*batches)
    return sent.select(F.col("batch").cast("int").alias("batch"), F.regexp_extract("rep.apply_url", r"(\d+)$", 1).cast("long").alias("part"), "n_members")


#: Deliveries of events, and days of each; rows are known for as many days of event time.
PERIODS, DAYS, TTL = 6, 5, "6 days"
_PERIOD = f"least((dayofyear(ts) - 1) // {DAYS}, {PERIODS - 1})"


@query(f"WITH e AS (SELECT event_id, {_PERIOD} AS period FROM events) SELECT event_id, CAST(period AS INTEGER) AS period FROM e UNION ALL SELECT event_id, {PERIODS - 1} FROM e WHERE period = 0")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream passes them on, each id once within six days of event time. A delivery brings a period's events, those
    of the period before again (known still), those of three periods before again (too late), and the last one also
    those of the first period with new times (no longer known, so they pass once more)."""
    feed, state, out = _folder(spark), _folder(spark), _folder(spark)
    period = F.least(F.floor((F.dayofyear("ts") - 1) / DAYS), F.lit(PERIODS - 1)).cast("int")
    events = table(spark, sf_dir, "events").select("event_id", "ts", period.alias("period"))
    for turn in range(PERIODS):
        rows = events.where(F.col("period").isin(turn, turn - 1, turn - 3)).select("event_id", "ts")
        if turn == PERIODS - 1:
            rows = rows.union(events.where("period = 0").select("event_id", F.col("ts") + F.expr(f"INTERVAL {DAYS * (PERIODS - 1)} DAYS")))
        rows.write.mode("append").parquet(feed)
        once = dedup_within(spark.readStream.schema("event_id long, ts timestamp").parquet(feed), "event_id", "ts", TTL)
        run = once.writeStream.option("checkpointLocation", state).format("parquet").outputMode("append").trigger(availableNow=True).start(out)
        run.awaitTermination()
    return spark.read.schema("event_id long, ts timestamp").parquet(out).select("event_id", period.alias("period"))


@query("""WITH p AS (SELECT o_custkey % 100 AS d, o_orderkey % 6 AS part, 'k' || o_orderkey AS key FROM orders), s AS (SELECT DISTINCT d, part, (d * 7 + part * 3) % 11 > 1 AS ok FROM p),
f AS (SELECT d, min(part) AS stop FROM s WHERE NOT ok GROUP BY d)
SELECT key, '2026-01-01T00:00:00' AS first_seen FROM p JOIN s USING (d, part) LEFT JOIN f USING (d) WHERE ok AND (stop IS NULL OR part < stop)
UNION ALL SELECT 'c' || c_custkey, '2025-01-01T00:00:00' FROM customer""")
def delivered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after a delivery in parts, some of which failed: keys up to each digest's first failed part are recorded."""
    o, d, part = table(spark, sf_dir, "orders"), F.col("o_custkey") % 100, F.col("o_orderkey") % 6
    parts = o.select(d.alias("digest_id"), part.alias("part_no"), _said("k", F.col("o_orderkey").cast("string")).alias("key"))
    status = parts.select("digest_id", "part_no").distinct().withColumn("ok", (F.col("digest_id") * 7 + F.col("part_no") * 3) % 11 > 1)
    seen = table(spark, sf_dir, "customer").select(_said("c", F.col("c_custkey").cast("string")).alias("key"), F.lit("2025-01-01T00:00:00").alias("first_seen"))
    return commit_delivered(seen, parts, status, F.lit("2026-01-01T00:00:00")).select(*(c.split()[0] for c in SEEN.split(", ")))


_CLUSTERS = "c AS (SELECT c_custkey AS cluster_id, ['u' || c_custkey, 's' || (c_custkey % 700), 'n' || (c_nationkey + CASE WHEN c_custkey % 9 = 0 THEN 100 * c_custkey ELSE 0 END)] AS keys FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT c_custkey, ['n' || c_nationkey] FROM customer WHERE c_custkey % 10 = 0)"


def _keyed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    many = F.array(_said("u", key.cast("string")), _said("s", (key % 700).cast("string")), _said("n", (nation + F.when(key % 9 == 0, 100 * key).otherwise(0)).cast("string")))
    return table(spark, sf_dir, "customer").select(key.alias("cluster_id"), F.when(key % 10 > 0, many).otherwise(F.array(_said("n", nation.cast("string")))).alias("keys"))


@query(f"""WITH {_CLUSTERS}, h AS (SELECT DISTINCT cluster_id, unnest(keys) AS key FROM c), n AS (SELECT key, count(*) AS n FROM h GROUP BY key), k AS (SELECT cluster_id, string_agg(key, ',' ORDER BY key) AS keys FROM h JOIN n USING (key) WHERE n = 1 GROUP BY 1)
SELECT cluster_id, coalesce(k.keys, list_aggregate(list_sort(c.keys), 'string_agg', ',')) AS keys FROM c LEFT JOIN k USING (cluster_id)""")
def unambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters without the keys that others hold too; those that hold nothing else keep them."""
    return strip_ambiguous(_keyed_customers(spark, sf_dir)).select("cluster_id", F.array_join(F.array_sort("keys"), ",").alias("keys"))


@query(f"WITH {_CLUSTERS} SELECT DISTINCT cluster_id, unnest(keys) AS key FROM c UNION SELECT cluster_id, 'gh:acme:' || cluster_id FROM c WHERE cluster_id % 2 = 0")
def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a sent cluster leaves in the ledger: its own, and that of the URL that it was sent with, if it has one."""
    url = F.when(F.col("cluster_id") % 2 == 0, _said("https://boards.greenhouse.io/acme/jobs/", F.col("cluster_id").cast("string"))).otherwise("")
    return keys_to_store(_keyed_customers(spark, sf_dir).withColumn("rep", F.struct(url.alias("apply_url")))).distinct()


@query("""WITH k AS (SELECT c_custkey // 40 AS doc, c_custkey % 5 AS kind FROM customer)
SELECT 'd' || doc AS source, CASE kind WHEN 0 THEN 'closed' ELSE 'section' END AS reason, count(*) + CASE kind WHEN 0 THEN 0 ELSE 2 END AS n FROM k WHERE kind IN (0, 1) GROUP BY doc, kind""")
def markdown_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pipe tables that are passed over, by source and reason: closed ones, and lines of tables (head and rule too)
    under a heading that is left out."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    link = F.when(key % 5 == 0, F.lit("🔒")).otherwise(_said("[a](https://x.org/", key.cast("string"), ")"))
    row = F.struct("c_custkey", _said("| Co ", key.cast("string"), " | Intern | X | ", link, " |").alias("line"))
    head = "| Company | Role | Location | Application/Link |\n|---|---|---|---|\n"

    def lines(kept) -> object:
        return F.array_join(F.transform(F.filter("rows", lambda r: kept(r["c_custkey"] % 5)), lambda r: r["line"]), "\n")

    docs = c.groupBy(F.floor(key / 40).alias("doc")).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # 40 rows a document
    text = _said("# Open\n", head, lines(lambda kind: kind != 1), "\n\n# Archive\n", head, lines(lambda kind: kind == 1), "\n")
    return parse_md_tables(docs.select(_said("d", F.col("doc").cast("string")).alias("source"), text.alias("text")), ("archive",))[1].select("source", "reason", "n")
