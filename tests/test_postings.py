"""Golden rows and properties of the postings operators."""

import random
from collections import Counter

from pyspark.sql import functions as F

from listingflow.functions import keys as K
from listingflow.functions import text as X
from listingflow.operators import digest, ledger, rules
from listingflow.operators.cluster import _greedy, soft_merge
from listingflow.operators.components import connected_components
from listingflow.operators.pages import TERMS, detect_job_pages, keyword_counts
from listingflow.sources.markdown import parse_md_tables


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_url_keys(spark):
    cases = {
        "https://boards.greenhouse.io/Acme/jobs/123?utm_source=x": "gh:acme:123",
        "https://acme.wd5.myworkdayjobs.com/en/job/Intern_JR-000-12": "wd:acme:jr00012",
        "https://acme.wd1.myworkdayjobs.com/x/Intern_jr00012": "wd:acme:jr00012",
        "https://jobs.lever.co/Acme/0F0F0F0F-0000-1111-2222-333333333333": "lv:acme:0f0f0f0f-0000-1111-2222-333333333333",
        "https://www.linkedin.com/jobs/view/intern-at-x-1234567": "li:1234567",
        "https://www.Example.com/Careers/?b=2&a=1&utm_medium=q#top": "url:example.com/careers?a=1&b=2",
        "https://example.com/a b|c?id=100%": "url:example.com/a b|c?id=100%25",
        "": "",
    }
    got = values(spark, [(u,) for u in cases], "u string", K.url_key("u"))
    assert [g[0] for g in got] == list(cases.values())


def test_identity(spark):
    rows = [("Acme, Inc.", "SWE Intern - Summer 2027", "Austin, TX, USA", ""), ("Acme", "", "", ""), ("The Acme Co", "Senior Engineer", "Remote", "Fall 2026")]
    got = values(spark, rows, "c string, t string, l string, s string", K.identity_key("c", "t", "l", "s"))
    assert [g[0] for g in got] == ["id:acme|swe|austin tx|intern|su2027", "", "id:acme|senior engineer||newgrad|fa2026"]


def test_rules(spark):
    df = spark.createDataFrame([(1, "Tax Intern", "A", ""), (2, "Tax Software Intern", "A", ""), (3, "Summer of Code", "A", ""), (4, "Unpaid Intern", "A", ""), (5, "Web Intern", "Jobright.ai", "")], "posting_id long, title string, company string, apply_url string").withColumn("category", F.lit(None).cast("string"))
    got = {r["posting_id"]: tuple(r["verdict"]) for r in rules.judge(df).collect()}
    assert (got[1][0], got[2][0], got[2][3], got[3][0], got[4][0], got[5][0]) == ("maybe", "keep", True, "drop", "maybe", "drop")


def test_home(spark):
    got = values(spark, [(["London, UK"],), (["London, UK", "Austin, TX"],), ([],), (["Toronto, Canada"],)], "l array<string>", rules.is_us(F.col("l")))
    assert [g[0] for g in got] == [False, True, True, False]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in got}
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_soft_merge_in_rounds_equals_the_pass_over_keys(spark):
    rng = random.Random(5)
    groups = [(n, rng.choice(["", "", "x", "y", "z"]), sorted({"id:all" if rng.random() < 0.3 else f"id:{rng.randrange(40)}" for _ in range(2)})) for n in rng.sample(range(1000), 60)]
    groups += [(2000 + n, "xy"[n % 5 == 0] if n % 3 else "", [f"id:p{n}", f"id:p{n + 1}"]) for n in range(6)]  # a chain
    table = spark.createDataFrame(groups, "root long, strong string, ids array<string>")
    once = dict(_greedy(table.toPandas()).itertuples(index=False))
    assert max(Counter(once.values()).values()) > 10
    assert {r["root"]: r["cluster_id"] for r in soft_merge(table, most=1, front=20).collect()} == once


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert ledger.read_ledger(spark, path)[1]
    ledger.write_ledger(spark.createDataFrame([("a", "2026-01-01")], ledger.SEEN), path)
    seen, first = ledger.read_ledger(spark, path)
    after = ledger.upsert_seen(seen, spark.createDataFrame([("a",), ("b",)], "key string"), F.lit("2027-01-01"))
    assert not first and sorted(map(tuple, after.collect())) == [("a", "2026-01-01"), ("b", "2027-01-01")]


def test_pack_halves_what_never_fits(spark):
    df = spark.createDataFrame([("d", i, i, 900 if i == 1 else 10) for i in range(1, 11)], "digest_id string, posting_id long, rank int, size int")
    rows = digest.pack(df, limit=500, overhead=0, tries=2).collect()
    assert sorted(r["posting_id"] for r in rows) == list(range(1, 11))
    sizes = {}
    for r in rows:
        sizes.setdefault(r["part_no"], []).append(900 if r["posting_id"] == 1 else 10)
    assert all(sum(s) <= 500 or len(s) == 1 for s in sizes.values())


def test_slots(spark):
    df = spark.createDataFrame([("2026-08-01 06:34:00",), ("2026-08-01 06:35:00",), ("2026-08-01 11:00:59",), ("2026-08-01 11:01:00",), ("2026-08-01 18:35:00",)], "t string").withColumn("ts", F.to_timestamp("t"))
    assert [r["slot"] for r in X.with_digest_slot(df, "ts", "UTC", am_deadline="11:00").collect()] == [None, "AM", "AM", None, "PM"]


def test_markdown_table(spark):
    text = "# Open\n| Company | Role | Location | Link |\n|---|---|---|---|\n| **A** &amp; Co | Intern | X | [Apply](https://a.com/1) |\n| ↳ | Dev | Y | <a href=\"https://a.com/2\">x</a> |\n| B | Old | Z | 🔒 |\n# Archive\n| C | D | E | [l](https://c.com) |\n"
    rows, skipped = parse_md_tables(spark.createDataFrame([("s", text)], "source string, text string"), ("archive",))
    assert [(r["company"], r["title"], r["apply_url"]) for r in rows.orderBy("pos").collect()] == [("**A** & Co", "Intern", "https://a.com/1"), ("**A** & Co", "Dev", "https://a.com/2")]
    assert {(r["reason"], r["n"]) for r in skipped.collect()} == {("closed", 1), ("section", 1)}


def test_pages_and_keywords(spark):
    pages = [
        (1, "https://x.com/a", '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","identifier":{"value":"AB1"}}]}</script>'),
        (2, "https://x.com/b", "<button>Apply now</button> Responsibilities and Qualifications"),
        (3, "https://x.com/c", "<p>hello</p>"),
        (4, "https://boards.greenhouse.io/a/jobs/1", "<title>T</title>"),
    ]
    got = {r["page_id"]: (r["signal"], r["key"]) for r in detect_job_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: ("json-ld", "job:ab1"), 2: ("text", "url:x.com/b"), 3: (None, None), 4: ("url", "gh:a:1")}
    words = {r["name"]: r["n"] for r in keyword_counts(spark.createDataFrame([(1, "python python, C++ and C. Go")], "doc_id long, text string")).collect()}
    assert words == {"Python": 1, "C++": 1, "Go": 1}


def test_all_terms(spark):
    assert (len(TERMS), len({t[0] for t in TERMS}), sum(len(t[2]) for t in TERMS), sum(t[3] for t in TERMS)) == (94, 94, 162, 3)
    text = "Ruby on Rails, PHP; HTML5 CSS. Docker/Linux, oauth cache"
    words = {r["name"] for r in keyword_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert words == {"Ruby", "Rails", "PHP", "HTML", "Docker", "Linux", "Authentication", "Caching"}
