"""Shaping of what is new into ordered digest parts of bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import short_location
from .components import checkpointed, stored
from .rules import is_meaningful

ORDER = ("is_maybe", "indirect", "company_low", "title_low", "ord")


def ranked_within(df: DataFrame, by: str, *order: str, name: str = "rank", kind: str = "int") -> DataFrame:
    """Adds the place of each row among those of its group: rows are dealt by ranges of the whole order and numbered
    within them, and counts of the ranges before are added, so no group is sorted in one task."""
    placed = checkpointed(df.repartitionByRange(by, *order).withColumn("_run", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(by, "_run").agg(F.count("*").alias("_n")).select(by, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(by, "_run").orderBy(*order)
    rows = placed.withColumn(name, F.row_number().over(within)).join(first, [by, "_run"])
    return rows.withColumn(name, (F.col(name) + F.col("_first")).cast(kind)).drop("_run", "_first")


def order_digest(df: DataFrame) -> DataFrame:
    """Adds rank within digest_id: direct first, maybe last, by company and title, then input order. Null companies
    and titles come first; rows without a digest_id are none of any digest."""
    low = df.where("digest_id IS NOT NULL").withColumns({"is_maybe": F.col("relevance") == "maybe", "company_low": F.lower("company"), "title_low": F.lower("title")})
    return ranked_within(stored(low), "digest_id", *ORDER)  # dealing by ranges reads its rows twice


def _halved(rows: pd.DataFrame) -> pd.DataFrame:
    """Splits an oversized part in halves until each fits or holds one entry."""
    rows = rows.sort_values("rank").reset_index(drop=True)
    limit, overhead = int(rows["limit"].iloc[0]), int(rows["overhead"].iloc[0])
    sub, stack = [0] * len(rows), [(0, len(rows))]
    n = 0
    while stack:
        a, b = stack.pop()
        if b - a > 1 and int(rows["size"].iloc[a:b].sum()) + overhead > limit:
            mid = (a + b + 1) // 2
            stack += [(mid, b), (a, mid)]
            continue
        sub[a:b] = [n] * (b - a)
        n += 1
    rows["sub"] = sub
    return rows[["digest_id", "posting_id", "rank", "part", "sub"]]


#: Entries of a block whose sizes are summed up together.
BLOCK = 4096


def _bytes_of_parts(entries: DataFrame, limit: int, overhead: int, tries: int) -> tuple[DataFrame, DataFrame]:
    """Totals of each digest (n, least), and the bytes of every part of every number of parts tried.

    A part is a run of ranks, so its bytes are the sizes up to its end without those up to its start. Only these cut
    points are looked up, not every entry for every number tried: a cut is put among the entries of its block, the
    running sum there and the sums of the blocks before are the sizes up to it.
    """
    blocks = checkpointed(entries.groupBy("digest_id", "block").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    totals = blocks.groupBy("digest_id").agg(F.sum("n").alias("n"), F.greatest(F.ceil((F.sum("size") + overhead) / limit), F.lit(1)).cast("int").alias("least"))
    before = Window.partitionBy("digest_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over a row per block
    earlier = blocks.select("digest_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    tried = totals.withColumn("parts", F.explode(F.expr(f"sequence(least, least + {tries})"))).withColumn("step", F.ceil(F.col("n") / F.col("parts")).cast("long"))
    cuts = tried.withColumn("part", F.explode(F.expr("sequence(1, int(ceil(n / step)))"))).withColumn("rank", F.least(F.col("part") * F.col("step"), "n").cast("long"))
    none = [F.lit(None).cast("int").alias(c) for c in ("parts", "part")]
    cuts = cuts.select("digest_id", F.floor((F.col("rank") - 1) / BLOCK).cast("long").alias("block"), "rank", F.lit(0).cast("long").alias("size"), "parts", "part", "n", "step")
    own = entries.select("digest_id", "block", F.col("rank").cast("long").alias("rank"), F.col("size").cast("long").alias("size"), *none, F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("step"))
    upto = F.sum("size").over(Window.partitionBy("digest_id", "block").orderBy("rank", F.col("parts").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    points = own.unionByName(cuts).withColumn("upto", upto).where("parts IS NOT NULL").join(earlier, ["digest_id", "block"]).withColumn("upto", F.col("upto") + F.col("earlier"))
    # sizes up to a cut count for the part that ends there, and against the one that begins there
    ends = F.array(F.struct(F.col("part").alias("part"), F.col("upto").alias("size")), F.struct((F.col("part") + 1).alias("part"), (-F.col("upto")).alias("size")))
    signed = points.select("digest_id", "parts", "n", "step", F.inline(ends)).where("(part - 1) * step < n")
    sums = signed.groupBy("digest_id", "parts", "part").agg((F.sum("size") + overhead).alias("bytes"), F.first("n").alias("n"), F.first("step").alias("step"))
    return totals, sums


def pack(df: DataFrame, limit: int = 92_000, overhead: int = 2_000, tries: int = 8, halve: bool = True) -> DataFrame:
    """(digest_id, posting_id, rank, part_no, parts) of ordered entries (digest_id, posting_id, rank, size).

    Parts are even in entries: as many as the bytes need, and up to `tries` more until every part fits. If
    none does, parts that are too large are halved, or with halve=False the most parts tried stay as they are. Ranks are
    1, 2, ... in each digest; entries with a null digest are none of any.
    """
    entries = df.where("digest_id IS NOT NULL").select("digest_id", "posting_id", "rank", "size", F.floor((F.col("rank") - 1) / BLOCK).cast("long").alias("block"))
    entries = checkpointed(entries)
    totals, sums = _bytes_of_parts(entries, limit, overhead, tries)
    sums = checkpointed(sums)
    most = sums.groupBy("digest_id", "parts").agg(F.max("bytes").alias("most"))
    chosen = most.groupBy("digest_id").agg(F.coalesce(F.min(F.when(F.col("most") <= limit, F.col("parts"))), F.max("parts")).alias("parts"))
    held = sums.join(chosen, ["digest_id", "parts"]).withColumn("over", (F.col("bytes") > limit) & (F.least("step", F.col("n") - (F.col("part") - 1) * F.col("step")) > 1))
    digests = held.groupBy("digest_id").agg(F.first("step").alias("step"), F.count("*").cast("int").alias("parts"), F.max("over").alias("over"))
    placed = entries.drop("block").join(digests, "digest_id").withColumn("part", F.floor((F.col("rank") - 1) / F.col("step")).cast("int"))
    if not halve:
        return placed.select("digest_id", "posting_id", "rank", (F.col("part") + 1).alias("part_no"), "parts")
    even = placed.where("NOT over").select("digest_id", "posting_id", "rank", (F.col("part") + 1).alias("part_no"), "parts")
    uneven = placed.where("over").drop("over").join(held.select("digest_id", (F.col("part") - 1).alias("part"), "over"), ["digest_id", "part"])
    rest = uneven.where("over").select("digest_id", "posting_id", "rank", "part", "size", F.lit(limit).alias("limit"), F.lit(overhead).alias("overhead"))
    halved = rest.groupBy("digest_id", "part").applyInPandas(_halved, "digest_id string, posting_id long, rank int, part int, sub int")
    both = checkpointed(uneven.where("NOT over").select("digest_id", "posting_id", "rank", "part", F.lit(0).alias("sub")).union(halved))
    per = Window.partitionBy("digest_id")  # over a row per part
    numbers = both.select("digest_id", "part", "sub").distinct().withColumn("part_no", F.row_number().over(per.orderBy("part", "sub"))).withColumn("parts", F.count("*").over(per).cast("int"))
    return even.unionByName(both.join(numbers, ["digest_id", "part", "sub"]).select("digest_id", "posting_id", "rank", "part_no", "parts"))


def batch(df: DataFrame, n: int = 150) -> DataFrame:
    """Adds batch_no: n ranked entries each."""
    return df.withColumn("batch_no", F.floor((F.col("rank") - 1) / n).cast("int"))


def group_same_role(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roles, members): one row per company, title, season and source, whatever their case, with its first posting, how many
    it has and its distinct short locations in the order in which they come up; and (role, posting_id) of each posting.

    A role of very many postings is counted, not gathered; only its distinct places are. Null fields are values of their
    own; of postings with one ord the smaller id is first.
    """
    low = F.to_json(F.struct(*(F.lower(c).alias(c) for c in ("company", "title", "season")), "source"))
    rows = df.select(F.md5(low).alias("role"), "ord", "posting_id", "company", "title", "source", short_location(F.col("location")).alias("place"))
    heads = rows.groupBy("role").agg(F.min(F.struct("ord", "posting_id", "company", "title", "source")).alias("first"), F.count("*").alias("n"))
    named = rows.where("place <> ''").groupBy("role", "place").agg(F.min("ord").alias("at"))
    places = named.groupBy("role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "place"))), lambda x: x["place"]), "; ").alias("places"))
    roles = heads.join(places, "role", "left").select("role", *(F.col(f"first.{c}").alias(c) for c in ("posting_id", "company", "title", "source")), "n", F.coalesce("places", F.lit("")).alias("places"))
    return roles, rows.select("role", "posting_id")


def section_counts(df: DataFrame) -> DataFrame:
    """direct, indirect and maybe entries per digest, and the headline count without maybe."""
    maybe = F.col("relevance") == "maybe"
    return df.groupBy("digest_id").agg(
        F.count_if(~maybe & ~F.col("indirect")).alias("direct"),
        F.count_if(~maybe & F.col("indirect")).alias("indirect"),
        F.count_if(maybe).alias("maybe"),
        F.count_if(~maybe).alias("headline"),
    )


SECTIONS = ((1, "Direct Apply"), (2, "LinkedIn (opens on LinkedIn)"), (3, "Maybe (off-domain or restricted -- review)"))  # fixed values: sections of a report, in order


def render_text(df: DataFrame) -> DataFrame:
    """(digest_id, part_no, body) of ordered entries (digest_id, part_no, rank, relevance, relevance_rule, indirect, company,
    title, season, source, location, salary, apply_url): under each section's header and count, a block per company,
    title, season and source, with places, season and salary, the rule that demoted it, and a line per posting.

    Null and placeholder fields are left out. A part is bounded by pack(), and so is a body. An empty table
    gives no rows.
    """
    where = F.when(F.col("relevance") == "maybe", 3).when(F.col("indirect"), 2).otherwise(1)
    fields = {c: F.coalesce(F.col(c), F.lit("")) for c in ("company", "title", "season", "source", "location", "salary", "apply_url", "relevance_rule")}
    rows = df.withColumns({**fields, "section": where})
    p = F.struct("rank", "company", "title", "season", "location", "salary", "relevance_rule", "apply_url", short_location(F.col("location")).alias("place"))
    keys = ["digest_id", "part_no", "section"]
    low = [F.lower(c).alias(f"k_{c}") for c in ("company", "title", "season")]
    held = rows.select(*keys, *low, "source", p.alias("p")).groupBy(*keys, "k_company", "k_title", "k_season", "source").agg(F.array_sort(F.collect_list("p")).alias("p"))
    first = F.get("p", F.lit(0))
    places = F.array_join(F.filter(F.array_distinct(F.transform("p", lambda x: x["place"])), lambda x: x != ""), ", ")
    meta = F.array_join(F.filter(F.array(F.when(places == "", first["location"]).otherwise(places), first["season"], first["salary"]), is_meaningful), " | ")
    lines = F.transform("p", lambda x: F.concat(F.when(F.size("p") > 1, F.concat(F.lit("  ["), x["place"], F.lit("] "))).otherwise("  "), x["apply_url"]))
    text = F.array_join(
        F.concat(
            F.array(F.concat(first["company"], F.lit(" - "), first["title"])),
            F.when(meta != "", F.array(F.concat(F.lit("  "), meta))).otherwise(F.array().cast("array<string>")),
            F.when(first["relevance_rule"] != "", F.array(F.concat(F.lit("  filtered: "), first["relevance_rule"]))).otherwise(F.array().cast("array<string>")),
            lines,
        ),
        "\n",
    )
    blocks = held.select(*keys, F.struct("k_company", "k_title", F.get("p", F.lit(0))["rank"].alias("rank"), text.alias("text")).alias("b"), F.size("p").alias("n"))
    per = blocks.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("b")).alias("b"))
    title = F.element_at(F.create_map(*(F.lit(x) for pair in SECTIONS for x in pair)), F.col("section"))
    head = F.concat(F.lit("== "), title, F.lit(" ("), F.col("n").cast("string"), F.lit(") ==\n\n"))
    whole = per.select("digest_id", "part_no", F.struct("section", F.concat(head, F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")).alias("text")).alias("s"))
    return whole.groupBy("digest_id", "part_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n\n").alias("body"))
