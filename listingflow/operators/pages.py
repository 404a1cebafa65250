"""Detection of posting pages and extraction of skill keywords from text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import ats_key, url_key

# Parts of hosts that serve postings, and phrases of a posting's sections.
JOB_HOSTS = (
    "applytojob", "jazzhr", "myworkdayjobs", "myworkday", "workday", "greenhouse", r"lever\.co", "ashbyhq", "rippling", "workable",
    "bamboohr", "jobvite", "icims", "smartrecruiters", "taleo", "successfactors", "paylocity", "paycomonline", "dayforce", "ultipro",
    r"breezy\.hr", "recruitee", "teamtailor", "eightfold", "phenom", "avature", "oraclecloud", r"adp\.com", "gr8people", r"jobs\.",
    r"careers\.", r"career\.", r"\.wd\d",
)
SECTIONS = (
    "responsibilities", "qualifications", "requirements", "what you'll do", "what you will do", "about the role", "about the job",
    "about this role", "job description", "who you are", "preferred qualifications", "minimum qualifications", "basic qualifications",
    "what we're looking for", "equal opportunity", "what you'll bring",
)
# Skill terms as name, category, aliases (patterns where they hold a backslash), case-sensitive.
TERMS = (
    ("Python", "Language", ("python",), False),
    ("JavaScript", "Language", ("javascript", "js", "es6"), False),
    ("TypeScript", "Language", ("typescript", "ts"), False),
    ("Java", "Language", ("java",), False),
    ("C++", "Language", (r"c\+\+", "cpp"), False),
    ("C#", "Language", ("c#", "c-sharp", "csharp"), False),
    ("C", "Language", ("C",), True),
    ("Go", "Language", ("Go", "Golang", "golang"), True),
    ("Rust", "Language", ("rust",), False),
    ("Ruby", "Language", ("ruby",), False),
    ("PHP", "Language", ("php",), False),
    ("Swift", "Language", ("swift",), False),
    ("Kotlin", "Language", ("kotlin",), False),
    ("Scala", "Language", ("scala",), False),
    ("R", "Language", ("R",), True),
    ("SQL", "Language", ("sql",), False),
    ("Bash", "Language", ("bash", "shell scripting", "shell"), False),
    ("MATLAB", "Language", ("matlab",), False),
    ("Perl", "Language", ("perl",), False),
    ("React", "Frontend", ("react", "react.js", "reactjs"), False),
    ("Angular", "Frontend", ("angular",), False),
    ("Vue", "Frontend", ("vue", "vue.js", "vuejs"), False),
    ("Next.js", "Frontend", ("next.js", "nextjs"), False),
    ("Redux", "Frontend", ("redux",), False),
    ("HTML", "Frontend", ("html", "html5"), False),
    ("CSS", "Frontend", ("css", "css3"), False),
    ("Tailwind", "Frontend", ("tailwind",), False),
    ("Sass", "Frontend", ("sass", "scss"), False),
    ("Node.js", "Backend", ("node.js", "nodejs", "node"), False),
    ("Express", "Backend", ("express", "express.js"), False),
    ("FastAPI", "Backend", ("fastapi",), False),
    ("Django", "Backend", ("django",), False),
    ("Flask", "Backend", ("flask",), False),
    ("Spring", "Backend", ("spring", "spring boot"), False),
    ("Rails", "Backend", ("rails", "ruby on rails"), False),
    (".NET", "Backend", (r"\.net", "dotnet", "asp.net"), False),
    ("GraphQL", "Backend", ("graphql",), False),
    ("REST API", "Backend", ("rest api", "restful", "rest"), False),
    ("gRPC", "Backend", ("grpc",), False),
    ("WebSockets", "Backend", ("websocket", "websockets"), False),
    ("Microservices", "Backend", ("microservice", "microservices"), False),
    ("pandas", "Data/ML", ("pandas",), False),
    ("NumPy", "Data/ML", ("numpy",), False),
    ("scikit-learn", "Data/ML", ("scikit-learn", "sklearn", "scikit learn"), False),
    ("PyTorch", "Data/ML", ("pytorch",), False),
    ("TensorFlow", "Data/ML", ("tensorflow",), False),
    ("Keras", "Data/ML", ("keras",), False),
    ("XGBoost", "Data/ML", ("xgboost",), False),
    ("Spark", "Data/ML", ("spark", "pyspark"), False),
    ("Hadoop", "Data/ML", ("hadoop",), False),
    ("Airflow", "Data/ML", ("airflow",), False),
    ("Kafka", "Data/ML", ("kafka",), False),
    ("ETL", "Data/ML", ("etl",), False),
    ("NLP", "Data/ML", ("nlp", "natural language processing"), False),
    ("Computer Vision", "Data/ML", ("computer vision",), False),
    ("Deep Learning", "Data/ML", ("deep learning",), False),
    ("Machine Learning", "Data/ML", ("machine learning", "ml"), False),
    ("LLM", "Data/ML", ("llm", "large language model", "large language models"), False),
    ("Pydantic", "Data/ML", ("pydantic",), False),
    ("PostgreSQL", "Database", ("postgresql", "postgres"), False),
    ("MySQL", "Database", ("mysql",), False),
    ("MongoDB", "Database", ("mongodb", "mongo"), False),
    ("Redis", "Database", ("redis",), False),
    ("SQLite", "Database", ("sqlite",), False),
    ("DynamoDB", "Database", ("dynamodb",), False),
    ("Cassandra", "Database", ("cassandra",), False),
    ("Elasticsearch", "Database", ("elasticsearch", "elastic search"), False),
    ("Snowflake", "Database", ("snowflake",), False),
    ("BigQuery", "Database", ("bigquery",), False),
    ("AWS", "Cloud/Infra", ("aws", "amazon web services"), False),
    ("Azure", "Cloud/Infra", ("azure",), False),
    ("GCP", "Cloud/Infra", ("gcp", "google cloud"), False),
    ("Docker", "Cloud/Infra", ("docker",), False),
    ("Kubernetes", "Cloud/Infra", ("kubernetes", "k8s"), False),
    ("Terraform", "Cloud/Infra", ("terraform",), False),
    ("Jenkins", "Cloud/Infra", ("jenkins",), False),
    ("GitHub Actions", "Cloud/Infra", ("github actions",), False),
    ("CI/CD", "Cloud/Infra", ("ci/cd", "cicd", "continuous integration", "continuous deployment"), False),
    ("Git", "Cloud/Infra", ("git", "github", "gitlab", "version control"), False),
    ("Linux", "Cloud/Infra", ("linux", "unix"), False),
    ("nginx", "Cloud/Infra", ("nginx", "openresty"), False),
    ("Lambda", "Cloud/Infra", ("lambda", "serverless"), False),
    ("Data Structures & Algorithms", "Concept", ("data structures", "algorithms", "dsa"), False),
    ("Object-Oriented Programming", "Concept", ("object-oriented", "object oriented", "oop"), False),
    ("Distributed Systems", "Concept", ("distributed systems", "distributed system"), False),
    ("System Design", "Concept", ("system design",), False),
    ("Agile", "Concept", ("agile", "scrum"), False),
    ("TDD", "Concept", ("tdd", "test-driven", "test driven"), False),
    ("Unit Testing", "Concept", ("unit test", "unit testing", "unit tests"), False),
    ("Integration Testing", "Concept", ("integration test", "integration testing"), False),
    ("Concurrency", "Concept", ("concurrency", "multithreading", "concurrent"), False),
    ("Caching", "Concept", ("caching", "cache"), False),
    ("Authentication", "Concept", ("authentication", "oauth", "jwt", "auth"), False),
    ("Design Patterns", "Concept", ("design patterns",), False),
)
_BOUND = "[^A-Za-z0-9+#.]"


def is_job_host(url: Column) -> Column:
    """Whether the URL is a known applicant system's or its host looks like one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    return (ats_key(url) != "") | host.rlike("|".join(JOB_HOSTS))


def section_phrases(html: Column) -> Column:
    """How many section phrases a page has."""
    low = F.lower(html)
    return sum((low.contains(p).cast("int") for p in SECTIONS), F.lit(0))


_NODE = "struct<json:string,open:boolean>"


def _node(text: Column) -> Column:
    """A JSON text, and whether there may be more in it: arrays and objects that have not been opened."""
    return F.struct(text.alias("json"), F.coalesce(F.ltrim(text).rlike(r"^[\[{]"), F.lit(False)).alias("open"))


def _opened(node: Column) -> Column:
    """What stands for a node in depth-first order: an array's items, an object and then its graph, anything else itself."""
    graph = F.get_json_object(node["json"], "$.@graph")
    items = F.transform(F.coalesce(F.from_json(node["json"], "array<string>"), F.array().cast("array<string>")), _node)
    own = F.array(F.struct(node["json"].alias("json"), F.lit(False).alias("open")))
    whole = F.when(graph.isNull(), own).otherwise(F.concat(own, F.array(_node(graph))))
    return F.when(~node["open"], F.array(node)).when(F.ltrim(node["json"]).startswith("["), items).otherwise(whole)


def _posting(html: Column) -> Column:
    """JSON text of the first JobPosting in a page's ld+json blocks; arrays and graphs are opened depth-first, however deep they are.

    No array or graph is deeper than the page has brackets and graphs, so opening is repeated that often, or until
    nothing is left to open. Blocks that are no JSON are passed over.
    """
    blocks = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())
    deepest = F.aggregate(blocks, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit("["), F.lit(""))) + F.size(F.split(x, "@graph")))
    turns = F.sequence(F.lit(0), deepest)

    def open_(nodes: Column, _: Column) -> Column:
        return F.when(F.exists(nodes, lambda n: n["open"]), F.flatten(F.transform(nodes, _opened))).otherwise(nodes)

    nodes = F.aggregate(turns, F.transform(blocks, _node).cast(f"array<{_NODE}>"), open_)
    return F.get(F.filter(nodes, lambda n: F.get_json_object(n["json"], "$.@type").rlike(r'(^|")JobPosting("|$)')), F.lit(0))["json"]


def detect_job_pages(df: DataFrame) -> DataFrame:
    """(page_id, is_job, signal, key, title) of pages (page_id, url, html): a known URL, else a JobPosting, else
    an og:type of job, else an apply control with two section phrases."""
    html = F.coalesce(F.col("html"), F.lit(""))
    page = df.withColumns({"k": url_key("url"), "posting": _posting(html), "page_title": F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))})
    link = F.coalesce(F.get_json_object("posting", "$.url"), F.get_json_object("posting", "$.hiringOrganization.sameAs"))
    ident = F.coalesce(F.get_json_object("posting", "$.identifier.value"), F.get_json_object("posting", "$.identifier"))
    og = F.regexp_extract(html, r"(?i)<meta[^>]*property=[\"']og:type[\"'][^>]*content=[\"']([^\"']*)", 1).rlike("(?i)job")
    tagged = F.regexp_extract_all(html, F.lit(r"(?is)<(?:a|button)\b[^>]*>.*?</(?:a|button)>|<[a-z0-9]+\b[^>]*\brole=[\"']button[\"'][^>]*>[^<]*|<input\b[^>]*\btype=[\"'](?:submit|button)[\"'][^>]*>"), F.lit(0))

    def said(control: Column) -> Column:
        """A control's text, else its value, else its label."""
        own = [F.trim(F.regexp_replace(control, "<[^>]+>", "")), *(F.trim(F.regexp_extract(control, rf"(?is)^<[^>]*\b{a}=[\"']([^\"']*)", 1)) for a in ("value", "aria-label"))]
        return F.lower(F.coalesce(*(F.nullif(x, F.lit("")) for x in own), F.lit("")))

    words = F.transform(tagged, said)
    apply = F.exists(words, lambda w: (F.length(w) <= 40) & w.rlike(r"^apply\b|^submit application$|apply (for|to) this (job|position|role)"))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    signal = F.when((F.col("k") != "") & ~F.col("k").startswith("url:"), "url").when(F.col("posting").isNotNull(), "json-ld").when(og, "og").when(apply & (section_phrases(body) >= 2), "text")
    linked = F.nullif(ats_key(link), F.lit(""))
    key = F.when(signal != "json-ld", F.col("k")).otherwise(F.when(link.isNotNull(), F.coalesce(linked, F.col("k"))).when(ident.isNotNull(), F.concat(F.lit("job:"), F.lower(ident))).otherwise(F.col("k")))
    title = F.when(signal == "json-ld", F.coalesce(F.get_json_object("posting", "$.title"), F.col("page_title"))).otherwise(F.col("page_title"))
    return page.select("page_id", signal.isNotNull().alias("is_job"), signal.alias("signal"), F.when(signal.isNotNull(), key).alias("key"), F.when(signal.isNotNull(), title).alias("title"))


def alias_pattern(alias: str, exact: bool) -> str:
    """The pattern of an alias between boundaries; an alias with a backslash is a pattern already."""
    body = alias if "\\" in alias else re.sub(r"[\\^$.|?*+(){}\[\]]", lambda m: "\\" + m[0], alias)
    return f"{'' if exact else '(?i)'}(?:^|{_BOUND})(?:{body})(?:{_BOUND}|$)"


#: A word is a run of what is no boundary.
_WORD = "[A-Za-z0-9+#.]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spelled(alias: str) -> str | None:
    """The text that an alias stands for, if it is one text that begins and ends with a word; else None."""
    text = re.sub(r"\\([^A-Za-z0-9])", "", alias)  # what is left of a pattern without its escaped signs
    if "\\" in alias and re.search(r"[\\^$.|?*+(){}\[\]]", text):
        return None
    text = re.sub(r"\\([^A-Za-z0-9])", r"\1", alias)
    return text if re.fullmatch(rf"{_WORD}(?:[^A-Za-z0-9+#.]+{_WORD})*", text) else None


def _alias_table(terms: tuple) -> tuple[dict[str, list[tuple]], list[tuple[int, str]], int]:
    """Aliases that are texts by their first word in small letters, as (alias, term, exact, text, words); patterns of
    the others by term; and the most words of an alias."""
    by_word, patterns, number = {}, [], 0
    for term, (_, _, aliases, exact) in enumerate(terms):
        for alias in aliases:
            text = _spelled(alias)
            if text is None:
                patterns.append((term, alias_pattern(alias, exact)))
                continue
            words = re.findall(_WORD, text)
            by_word.setdefault(words[0].lower(), []).append((number, term, exact, text if exact else text.lower(), len(words)))
            number += 1
    return by_word, patterns, max((a[4] for own in by_word.values() for a in own), default=1)


def keyword_counts(df: DataFrame, terms: tuple = TERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, category, n) of terms found: matches per alias that do not overlap, added up. A boundary
    is part of a match, so of two equal words with one space between them one counts.

    A text is cut once into words and what lies between them. Words that begin an alias are kept with what follows
    them, and compared with the aliases of that word; an alias that isn't a text but a pattern is matched by itself. All
    of it is within the row: nothing is shuffled. Null texts count as empty; ids may be null or repeat.
    """
    by_word, patterns, most = _alias_table(terms)
    kind = "struct<alias:int,term:int,exact:boolean,text:string,words:int>"
    names = ("alias", "term", "exact", "text", "words")
    # literals of the plan: as many as the table of terms, whatever the texts are
    table = F.from_json(F.lit(json.dumps({w: [dict(zip(names, a)) for a in own] for w, own in by_word.items()})), f"map<string,array<{kind}>>") if by_word else F.lit(None).cast(f"map<string,array<{kind}>>")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"), F.split("text", _WORD, -1).alias("between"))

    def small(c: Column) -> Column:
        return F.translate(c, _UPPER, _LOWER)  # letters of the patterns fold by ASCII alone

    def placed(word: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), small(word).alias("low"))

    hits = F.filter(F.transform("words", placed), lambda x: x["low"].isin(*by_word))
    rows = rows.withColumn("hits", hits)

    def spread(hit: Column) -> Column:
        parts = [F.get("words", hit["at"])]
        for k in range(1, most):
            parts += [F.coalesce(F.get(name, hit["at"] + k), F.lit("")) for name in ("between", "words")]
        return F.struct(hit["at"].alias("at"), F.concat(*parts).alias("run"), F.length(F.get("between", hit["at"])).alias("gap"), F.element_at("aliases", hit["low"]).alias("own"))

    def meets(x: Column, a: Column) -> Column:
        run = F.when(a["exact"], x["run"]).otherwise(small(x["run"]))
        after = F.substr(run, F.length(a["text"]) + 1, F.lit(1))
        return run.startswith(a["text"]) & ~after.rlike(_WORD)

    def found(x: Column) -> Column:
        own = F.filter(x["own"], lambda a: meets(x, a))
        return F.transform(own, lambda a: F.struct(a["alias"].alias("alias"), a["term"].alias("term"), x["at"].alias("at"), x["gap"].alias("gap"), a["words"].alias("words")))

    some = rows.where(F.size("hits") > 0) if not patterns else rows
    some = some.withColumn("aliases", table).withColumn("near", F.transform("hits", spread)).withColumn("found", F.flatten(F.transform("near", found)))

    def counted(alias: Column) -> Column:
        """Of an alias's places in order those are matches that begin after the boundary of the match before."""
        seed = F.struct(F.lit(-1).alias("next"), F.lit(0).alias("n"))

        def step(s: Column, x: Column) -> Column:
            free = (x["at"] > s["next"]) | (x["at"] == s["next"]) & (x["gap"] > 1) | (s["n"] == 0)
            return F.when(free, F.struct((x["at"] + x["words"]).alias("next"), (s["n"] + 1).alias("n"))).otherwise(s)

        return F.aggregate(F.filter("found", lambda x: x["alias"] == alias["alias"]), seed, step, lambda s: F.struct(alias["term"].alias("term"), s["n"].alias("n")))

    some = some.withColumn("counts", F.transform(F.array_distinct(F.transform("found", lambda x: F.struct(x["alias"].alias("alias"), x["term"].alias("term")))), counted))
    for term, pattern in patterns:
        own = F.struct(F.lit(term).alias("term"), F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("n"))
        some = some.withColumn("counts", F.concat("counts", F.filter(F.array(own), lambda x: x["n"] > 0)))
    labels = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(category).alias("category")) for name, category, *_ in terms))

    def summed(term: Column) -> Column:
        n = F.aggregate(F.filter("counts", lambda x: x["term"] == term), F.lit(0), lambda s, x: s + x["n"])
        return F.struct(term.alias("term"), n.alias("n"))

    totals = some.select("id", F.inline(F.transform(F.array_distinct(F.transform("counts", lambda x: x["term"])), summed)))
    label = F.get(labels, F.col("term"))
    return totals.select(F.col("id").alias(id_col), label["name"].alias("name"), label["category"].alias("category"), "n")


def rank_keywords(found: DataFrame) -> DataFrame:
    """Terms by total count, then by name in the order of the Unicode collation, with their place."""
    totals = found.groupBy("name", "category").agg(F.sum("n").alias("n"))  # a row per term
    order = [F.desc("n"), F.collate("name", "UNICODE"), "name"]
    return totals.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order))).orderBy("place")


def split_by_profile(found: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds have: whether the profile text has the term."""
    return found.join(profile.select("name").distinct().withColumn("have", F.lit(True)), "name", "left").fillna(False, ["have"])


def merge_frames(df: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """One text per page: its frames' texts in order, a line each."""
    held = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("f"))
    return held.select(by, F.array_join(F.transform("f", lambda x: x[text]), "\n").alias(text))
