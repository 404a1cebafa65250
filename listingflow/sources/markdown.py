"""Postings from pipe tables in markdown documents, line by line in windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cell_text, is_separator, split_row

# Header words in order of preference, and the field each names.
HEADERS = (
    ("company", "company"), ("org", "company"), ("role", "title"), ("position", "title"), ("opportunity", "title"), ("location", "location"),
    ("application/link", "apply"), ("application", "apply"), ("apply", "apply"), ("posting", "apply"), ("link", "apply"), ("salary", "salary"),
    ("date posted", "posted"), ("added", "posted"), ("age", "posted"), ("date", "posted"),
)
JUNK = r"(?i)(imgur\.com|shields\.io|discord\.(gg|com)|github\.com|githubusercontent\.com|speedyapply\.com|linkedin\.com/company|twitter\.com|\.(png|jpg|jpeg|svg|gif)$)"
CARRY, CLOSED = "↳", "🔒"
FIELDS = ("company", "title", "location", "apply", "salary", "posted")


def first_link(cell: Column) -> Column:
    """The first link that is not junk: of hrefs, then of markdown links."""

    def of(pattern: str) -> Column:
        return F.get(F.filter(F.regexp_extract_all(cell, F.lit(pattern), F.lit(1)), lambda u: ~u.rlike(JUNK)), F.lit(0))

    return F.coalesce(of(r"(?i)href=[\"'](https?://[^\"']+)[\"']"), of(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(""))


def _columns(cells: Column) -> Column:
    """Which cell holds each field: for each cell the first header word it has, the first cell of a field wins."""
    low = F.transform(cells, lambda c: F.lower(c))
    field = F.transform(low, lambda c: reduce(lambda rest, h: F.when(c.contains(h[0]), h[1]).otherwise(rest), reversed(HEADERS), F.lit("")))
    return F.struct(*(F.array_position(field, f).cast("int").alias(f) for f in FIELDS))


def parse_md_tables(docs: DataFrame, skip_sections: tuple[str, ...] = (), id_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, skipped) of documents: rows of tables that have a company column, outside skipped sections.

    A heading opens a section; a line that is no table row ends a table; a header may come again. Closed
    rows go before an empty or carried company cell takes the last one. skipped counts closed and
    sectioned rows per document.
    """
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\R", -1)).alias("n", "raw")).withColumn("line", F.trim("raw"))
    per = Window.partitionBy("doc").orderBy("n")
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*$", 1)
    skip = reduce(lambda a, b: a | b, (heading.rlike("(?i)" + p) for p in skip_sections), F.lit(False))
    is_head = F.col("line").rlike(r"^#{1,6}\s+")
    lines = lines.withColumn("skip", F.coalesce(F.last(F.when(is_head, skip), ignorenulls=True).over(per), F.lit(False)))
    lines = lines.withColumn("segment", F.sum(F.when(~F.col("line").startswith("|"), 1).otherwise(0)).over(per))
    rows = lines.where("startswith(line, '|')")
    sectioned = rows.where("skip")
    rows = rows.where("NOT skip").withColumn("cells", split_row(F.col("line"))).where(~is_separator(F.col("cells")))
    low = F.transform("cells", lambda c: F.lower(F.trim(c)))
    rows = rows.withColumn("is_header", F.array_contains(low, "company") | F.array_contains(low, "org"))
    table = Window.partitionBy("doc", "segment").orderBy("n")
    rows = rows.withColumn("map", F.last(F.when(F.col("is_header"), _columns(F.col("cells"))), ignorenulls=True).over(table)).withColumn("header", F.sum(F.col("is_header").cast("int")).over(table))
    rows = rows.where(~F.col("is_header") & F.col("map").isNotNull()).withColumn("apply_at", F.when(F.col("map.apply") > 0, F.col("map.apply")).otherwise(F.col("map.title")))
    rows = rows.where("map.company > 0 AND apply_at > 0")
    closed = rows.where(F.col("line").contains(CLOSED))
    rows = rows.where(~F.col("line").contains(CLOSED))

    def cell(at: Column) -> Column:
        return F.coalesce(F.when(at > 0, F.get("cells", at - 1)), F.lit(""))

    raw = cell_text(cell(F.col("map.company")))
    own = F.when(raw.startswith(CARRY) | (raw == ""), F.lit(None)).otherwise(raw)
    under = Window.partitionBy("doc", "segment", "header").orderBy("n")
    rows = rows.withColumn("company", F.coalesce(F.last(own, ignorenulls=True).over(under), F.lit("")))
    out = rows.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("pos"),
        "company",
        cell_text(cell(F.col("map.title"))).alias("title"),
        first_link(cell(F.col("apply_at"))).alias("apply_url"),
        cell_text(cell(F.col("map.location"))).alias("location"),
        cell_text(cell(F.col("map.salary"))).alias("salary"),
        cell_text(cell(F.col("map.posted"))).alias("posted"),
    )
    skipped = closed.select(F.col("doc").alias(id_col), F.lit("closed").alias("reason")).union(sectioned.select("doc", F.lit("section"))).groupBy(id_col, "reason").agg(F.count("*").alias("n"))
    return out.where("company <> '' AND title <> '' AND apply_url <> ''"), skipped
