"""Filters and explainable rules on postings."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import INTERN, NEW_GRAD
from .components import checkpointed

# Relevance rules by list, in order.
RULES = {
    "allow_title": (
        r"\b(software|swe|sde|developer|programmer|coding)\b",
        r"\b(infrastructure|platform|backend|back[- ]end|frontend|front[- ]end|full[- ]?stack|distributed systems?|operating systems?|systems software|systems engineer)\b",
        r"\b(embedded|firmware|compiler|kernel|graphics|gameplay|game)\b",
        r"\b(ml|machine\s*learning|ai|artificial intelligence|deep\s*learning|nlp|computer\s*vision|algorithms?|research scientist|applied scientist)\b",
        r"\b(data|analytics|quant|quantitative|statistics|statistical)\b",
        r"\b(security|cyber|devops|sre|cloud|network|mobile|ios|android|web|robotics|autonomy|autonomous|simulation)\b",
        r"\b(computer science)\b",
    ),
    "block_title": (
        r"\bgeneral interest\b",
        r"\bskillbridge\b",
        r"\b(summer of code|outreachy)\b",
        r"\b(fellowship|scholars?|student ambassadors?|mentorship program)\b",
        r"\bexpress your interest\b",
        r"\btalent (community|network|pool)\b",
        r"\bjoin our talent\b",
    ),
    "block_company": (r"^(genusjob|meeboss)\b", r"^jobright"),
    "block_url": (r"summerofcode\.withgoogle\.com", r"outreachy\.org", r"fellowship\.mlh\.io", r"databricks\.com/university", r"mvp\.microsoft\.com/studentambassadors", r"neo\.com/scholars"),
    "restrict_title": (r"\bunpaid\b", r"\bwith\s+(drexel|northeastern|purdue|uiuc|rit|penn state)\b", r"\b(students? only|restricted to)\b"),
    "maybe_title": (
        r"\bresearch park\b",
        r"\b(tax|audit|auditing|accounting|payroll|bookkeep)\b",
        r"\b(human resources|recruiting|recruiter|talent acquisition)\b",
        r"\b(marketing|advertising|public relations|communications|journalism)\b",
        r"\b(sales|business development|account executive|purchasing|procurement|supply chain|logistics|warehouse)\b",
        r"\b(geolog|geoscien|geophys|petroleum|mining|metallurg|hydrolog|seismic|drilling|reservoir)",
        r"\b(nurse|nursing|clinical|pharmac|dental|veterinar|social work)\b",
        r"\b(paralegal|legal|attorney|compliance officer)\b",
        r"\b(mechanical|civil|structural|architectural|interior design|culinary|hospitality)\b",
        r"\bproduct\s+(manage(r|ment)|owner|marketing)\b",
        r"\b(rotational?\s+program|leadership\s+development\s+program)\b",
        r"\boperations\s+(management|finance|analyst|intern)\b|\bcorporate\s+functions\b",
        r"\ball\s+tracks\b|\bearly\s+interest\b|\bgeneral\s+application\b",
        r"\b(asic|fpga|vlsi|rtl|rf|silicon|semiconductor|photonics?|analog|mixed[- ]signal|pcb|circuits?|power electronics|signal integrity|chip design|physical design)\b",
        r"\b(hardware|electrical|electronics?|thermal|mechatronics?|manufacturing|industrial|aerospace|propulsion|materials|optics?|optical|antenna|radar)\b",
    ),
}
MAYBE_CATEGORIES = ("Hardware", "Hardware Engineering")

# Places outside the country, as parts of a location, and as a word of their own.
FOREIGN = (
    "united kingdom", "england", "scotland", "wales", "ireland", "canada", "india", "germany", "france", "spain", "netherlands",
    "singapore", "japan", "china", "australia", "israel", "switzerland", "sweden", "poland", "brazil", "mexico", "korea", "taiwan",
    "hong kong", "united arab emirates", "dubai", "italy", "norway", "denmark", "finland", "belgium", "austria", "portugal",
    "romania", "czech", "hungary", "greece", "turkey", "argentina", "chile", "colombia", "philippines", "vietnam", "thailand",
    "indonesia", "malaysia", "new zealand", "south africa", "egypt", "nigeria", "kenya", "ukraine", "bulgaria", "serbia",
    "croatia", "lithuania", "latvia", "estonia", "luxembourg", "iceland", "peru",
)
FOREIGN_WORDS = ("uk",)
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "tbd", "?")
BOT_CODES = ("403", "429")


def is_open(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("active") & F.col("is_visible"), F.lit(False)))


def category_ok(c: Column, deny: tuple[str, ...], allow: tuple[str, ...] = ()) -> Column:
    fine = ~F.coalesce(c.isin(*deny), F.lit(False)) if deny else F.lit(True)
    return fine & F.coalesce(c.isin(*allow), F.lit(False)) if allow else fine


def season_wanted(terms: Column, years: tuple[str, ...]) -> Column:
    """Whether some named term holds a wanted year."""
    named = F.filter(terms, lambda t: (t != "") & (F.upper(t) != "N/A"))
    return F.coalesce(F.exists(named, lambda t: reduce(lambda a, b: a | b, (t.contains(y) for y in years))), F.lit(False))


def looks_foreign(c: Column) -> Column:
    low = F.lower(c)
    words = F.transform(F.split(low, r"[\s/]+"), lambda t: F.btrim(t, F.lit(" ,.()")))
    return low.rlike("|".join(FOREIGN)) | F.arrays_overlap(words, F.array(*map(F.lit, FOREIGN_WORDS)))


def is_us(locations: Column) -> Column:
    """True unless every named location is foreign."""
    named = F.filter(locations, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.coalesce((F.size(named) == 0) | F.exists(named, lambda x: ~looks_foreign(x)), F.lit(True))


def is_complete(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, (F.trim(F.coalesce(c, F.lit(""))) != "" for c in cs))


def is_internship(title: Column, source: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return F.when(t.rlike(INTERN), True).when(source == "LinkedIn", False).otherwise(~t.rlike(NEW_GRAD))


def is_meaningful(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*PLACEHOLDERS)


def is_aggregator(url: Column, hosts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(url).contains(h) for h in hosts))


def profile_filter(df: DataFrame, filters: dict[str, list]) -> Column:
    """All of `field IN values`; array fields match on overlap, and empty value lists are left out."""
    kinds = dict(df.dtypes)
    tests = [F.arrays_overlap(k, F.array(*map(F.lit, v))) if kinds[k].startswith("array") else F.col(k).isin(*v) for k, v in filters.items() if v]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _first(c: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern that the text matches. Patterns without numbered references are tried as one before."""
    found = F.coalesce(*(F.when(c.rlike("(?i)" + p), F.lit(p)) for p in patterns), F.lit(None).cast("string"))
    joint = len(patterns) > 1 and not any(re.search(r"\\[1-9kQ]|\(\?[^:=!]|#", p) for p in patterns)
    return F.when(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), found) if joint else found


#: Up to so many distinct titles, what rules find in them is sent to all tasks; of more, each posting's title is tried.
TITLES_SENT = 100_000


def _with_hits(df: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds for each list of rules the first pattern found. Titles come up again and again: each is tried once."""
    columns = {"allow_title": "title", "block_title": "title", "block_company": "company", "block_url": "apply_url", "restrict_title": "title", "maybe_title": "title"}
    hits = {k: (f"_{k}", _first(F.coalesce(F.col(columns[k]), F.lit("")), v)) for k, v in rules.items()}
    of_title = [k for k in rules if columns[k] == "title"]
    titles = checkpointed(df.select(F.coalesce("title", F.lit("")).alias("title")).distinct())
    if titles.count() > TITLES_SENT:
        return df.withColumns(dict(hits.values()))
    found = titles.select(F.col("title").alias("_of"), *(hits[k][1].alias(hits[k][0]) for k in of_title))
    rows = df.join(F.broadcast(found), F.coalesce(df["title"], F.lit("")) == F.col("_of"), "left").drop("_of")
    return rows.withColumns(dict(hits[k] for k in rules if k not in of_title))


def judge(df: DataFrame, rules: dict[str, tuple[str, ...]] = RULES, mode: str = "maybe", enabled: bool = True) -> DataFrame:
    """Adds verdict (action, rule, pattern, rescued): blocks drop, restrictions and off-domain titles or
    categories demote (or drop in mode 'drop'), and an allowed title rescues from the last two. The first
    pattern of a list is reported."""
    kind = "action string, rule string, pattern string, rescued boolean"
    if not enabled or mode == "off":
        return df.withColumn("verdict", F.struct(F.lit("keep").alias("action"), F.lit("").alias("rule"), F.lit("").alias("pattern"), F.lit(False).alias("rescued")).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    hit = _with_hits(df, rules).withColumn("_maybe_category", F.when(F.col("category").isin(*MAYBE_CATEGORIES), F.col("category")))

    def out(action: str, rule: str, pattern: Column, rescued: bool = False) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"), F.coalesce(pattern, F.lit("")).alias("pattern"), F.lit(rescued).alias("rescued"))

    soft = "drop" if mode == "drop" else "maybe"
    verdict = F.when(F.lit(False), out("keep", "", F.lit("")))
    for rule in ("block_title", "block_company", "block_url"):
        verdict = verdict.when(F.col(f"_{rule}").isNotNull(), out("drop", rule, F.col(f"_{rule}")))
    verdict = verdict.when(F.col("_restrict_title").isNotNull(), out(soft, "restrict_title", F.col("_restrict_title")))
    for rule in ("maybe_title", "maybe_category"):
        found = F.col(f"_{rule}").isNotNull()
        verdict = verdict.when(found & F.col("_allow_title").isNotNull(), out("keep", rule, F.col(f"_{rule}"), True)).when(found, out(soft, rule, F.col(f"_{rule}")))
    return hit.withColumn("verdict", verdict.otherwise(out("keep", "", F.lit("")))).drop(*(f"_{k}" for k in (*rules, "maybe_category")))


def tag(df: DataFrame, rules: dict[str, tuple[str, ...]] = RULES, mode: str = "maybe") -> DataFrame:
    """Postings that are not dropped, with relevance and, if that is maybe, relevance_rule."""
    # made a row of its own, so that the filter doesn't judge a second time
    judged = judge(df, rules, mode).withColumn("verdict", F.explode(F.array("verdict"))).where("verdict.action <> 'drop'")
    return judged.withColumns({"relevance": F.col("verdict.action"), "relevance_rule": F.when(F.col("verdict.action") == "maybe", F.col("verdict.rule")).otherwise("")})


def filter_counted(df: DataFrame, runs: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the predicate, and per source (empty ones too) how many were kept and dropped."""
    fine = F.coalesce(predicate, F.lit(False))
    counts = df.groupBy("source").agg(F.count_if(fine).alias("kept"), F.count_if(~fine).alias("dropped"))
    return df.where(fine), runs.join(counts, "source", "left").fillna(0, ["kept", "dropped"])


def match_all_rules(df: DataFrame, rules: dict[str, tuple[str, ...]] = RULES, column: str = "title") -> DataFrame:
    """A row per posting and matching rule: posting_id, list, ord, pattern. The rules are a literal array in
    the plan, so no table is joined."""
    flat = [(k, n, p) for k, v in rules.items() for n, p in enumerate(v)]
    hits = F.array(*(F.when(F.col(column).rlike("(?i)" + p), F.struct(F.lit(k).alias("list"), F.lit(n).alias("ord"), F.lit(p).alias("pattern"))) for k, n, p in flat))
    return df.select("posting_id", F.inline(F.array_compact(hits)))


def unknown_categories(df: DataFrame, known: list[str], deny: list[str]) -> DataFrame:
    """Categories seen that are neither known nor denied."""
    return df.select("category").distinct().where(F.col("category").isNotNull() & ~F.col("category").isin(*known, *deny))


def filter_audit(judged: DataFrame) -> DataFrame:
    """Members of each bucket, a row each: label (DROP, MAYBE or SAVED), rule, pattern, n of the bucket, posting_id, title.
    So no bucket is gathered in one row, whatever its size."""
    v = F.col("verdict")
    label = F.when(v["rescued"], "SAVED").when(v["action"] == "drop", "DROP").when(v["action"] == "maybe", "MAYBE")
    rows = judged.select(label.alias("label"), v["rule"].alias("rule"), v["pattern"].alias("pattern"), "posting_id", "title").where("label IS NOT NULL")
    bucket = ["label", "rule", "pattern"]  # a bucket per rule pattern: a small table
    return rows.join(rows.groupBy(bucket).agg(F.count("*").alias("n")), bucket).select(*bucket, "n", "posting_id", "title")


def audit_summary(judged: DataFrame) -> DataFrame:
    a = F.col("verdict.action")
    return judged.agg(F.count("*").alias("judged"), F.count_if(a == "keep").alias("keep"), F.count_if(a == "maybe").alias("maybe"), F.count_if(a == "drop").alias("drop"), F.count_if(F.col("verdict.rescued")).alias("rescued"))


#: Characters of a literal that a table of rules is looked up by.
GRAM = 3


def _anchors(tree) -> list[str] | None:
    """Small texts of which any match of a parsed pattern has one, or None if there is no such choice of GRAM letters each.

    Of a sequence the choice with fewest texts is taken, of an alternation the choices of all branches.
    """
    choices, run = [], ""

    def closed() -> None:
        if len(run) >= GRAM:
            choices.append([run[-GRAM:]])

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(value).lower() if value < 128 else chr(value)
            continue
        closed()
        run = ""
        own = None
        if name == "SUBPATTERN":
            own = _anchors(value[-1])
        elif name == "BRANCH":
            parts = [_anchors(branch) for branch in value[1]]
            own = sorted({x for part in parts for x in part}) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            own = _anchors(value[2])
        if own:
            choices.append(own)
    closed()
    return min(choices, key=len) if choices else None


def _indexed(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for batch in batches:
        found = []
        for name, place, pattern in batch.itertuples(index=False):
            try:
                grams = _anchors(re._parser.parse(pattern)) or [""]
            except (re.error, OverflowError, RecursionError):  # another dialect: the pattern is tried on all
                grams = [""]
            found += [(name, place, pattern, g) for g in grams]
        yield pd.DataFrame(found, columns=["list", "ord", "pattern", "gram"])


def match_rule_table(df: DataFrame, table: DataFrame, column: str = "title", most: int = 500_000) -> DataFrame:
    """(posting_id, list, ord, pattern) of each posting and each rule of a table (list, ord, pattern) that its text matches.

    Each pattern gives texts of three letters of which a match must have one; rules are looked up by the texts of
    three letters that a value has, and only those found are tried. A pattern without such texts is looked up by the
    empty text, which every value has. Values are tried once each, however many postings have them; the index of
    rules is sent to all tasks up to `most` rows. Letters fold by ASCII. Null values match nothing.
    """
    rows = table.select("list", F.col("ord").cast("long").alias("ord"), "pattern").where("pattern IS NOT NULL")
    index = checkpointed(rows.mapInPandas(_indexed, "list string, ord bigint, pattern string, gram string"))
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    low = F.translate("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = F.when(F.length("value") >= GRAM, F.transform(F.sequence(F.lit(1), F.length("value") - GRAM + 1), lambda i: F.substr(low, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    held = values.select("value", F.explode(F.array_distinct(F.concat(grams, F.array(F.lit(""))))).alias("gram"))
    found = held.join(F.broadcast(index) if index.count() <= most else index, "gram").drop("gram").distinct()
    hits = found.where(F.expr("value rlike pattern"))
    return df.select("posting_id", F.col(column).alias("value")).join(hits, "value").select("posting_id", "list", "ord", "pattern")
