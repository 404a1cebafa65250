"""Registered queries against their SQL, and operators on texts, rules, pages and digests against plain Python."""

import html
import json
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from listingflow.functions import keys
from listingflow.functions.text import decode_entities
from listingflow.operators import audit, digest, pages, rules
from listingflow.operators.cluster import cluster
from listingflow.operators.components import checkpoint_folder
from listingflow.plans.postings import postings_view
from listingflow.plans import stream_queries
from listingflow.plans.registry import QUERIES, SQL
from listingflow.sources import feeds
from listingflow.streaming.digest import dedup_within

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, name):
    with duckdb.connect() as db:
        for table in os.listdir(SF):
            db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
        want = db.execute(SQL[name])
        columns = [c[0] for c in want.description]
        rows = QUERIES[name](spark, SF)
        assert sorted(rows.columns) == sorted(columns)
        assert sorted(map(repr, map(tuple, rows.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_query_is_registered_once():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == {"entity_clusters", "reconciliation"}
    assert set(QUERIES) <= set(entry.queries())


def test_references_equal_the_standard(spark):
    rng = random.Random(2)
    names = list(html.entities.html5)
    texts = ["&" + n for n in names] + ["&" + n.rstrip(";") + "x" for n in names]
    texts += [f"&#{n};" for n in [*range(300), 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**12, 8364, 128512]] + [f"&#x{n:x}" for n in range(300)]
    texts += ["&#X1F600;", "&#0065;", "&#x0;", "&#;", "&#x;", "&", "&&", "& amp;", "&amp;lt;", "&ampamp;", "a &lt;b&gt; &notit; &notin; &unknown; &copycat", "&#99999999999999999999;", "plain", ""]
    texts += ["".join(rng.choice(["&", "amp", "lt;", "#", "x41", ";", " ", "é", "😀", "not", "in;", "copy", "\n"]) for _ in range(12)) for _ in range(1000)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", decode_entities(F.col("t")).alias("out"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r for r in rows.collect() if r["out"] != (r["t"] and html.unescape(r["t"])) and r["t"] is not None] == []


def test_keyword_counts_equal_patterns(spark):
    rng = random.Random(1)
    words = ["python", "Python", "js", "c", "C", "C++", "c#", "c-sharp", "Go", "go", "rest", "api", "REST", "shell", "scripting", "ci/cd", "asp.net", ".NET", "react.js", "scikit", "learn", "R", "ruby", "on", "rails", "é", "😀", "machine", "learning", "a", "K"]
    between = [" ", " ", " ", "  ", "-", "/", "\n", ", ", "é", "😀", "+", ".", "#", "K", "$"]
    texts = ["".join(rng.choice(words) + rng.choice(between) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["python " * n for n in range(1, 9)] + ["rest api rest api rest api", "rest api  rest api", "a.net .net", "x\npython\n", "", None]
    terms = pages.TERMS + (("Pattern", "X", (r"py\w+n",), False), ("Edge", "X", ("(x)", "[y"), False), ("Twice", "X", ("a a",), False))
    got = {}
    for r in pages.keyword_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), terms).collect():
        got.setdefault(r["doc_id"], {})[r["name"]] = r["n"]
    for i, text in enumerate(texts):
        want = {name: sum(len(re.findall(pages.alias_pattern(a, exact), text or "", re.ASCII)) for a in aliases) for name, _, aliases, exact in terms}
        assert got.get(i, {}) == {k: n for k, n in want.items() if n}, text
    repeated = spark.createDataFrame([(1, "sql", "x"), (1, "sql", "y"), (None, "sql", "z")], "doc_id long, text string, name string")
    assert sorted(map(repr, map(tuple, pages.keyword_counts(repeated).collect()))) == sorted(map(repr, [(1, "SQL", "Language", 1)] * 2 + [(None, "SQL", "Language", 1)]))
    assert pages.keyword_counts(repeated.limit(0)).count() == 0


def test_terms_are_ranked_by_collation(spark):
    found = spark.createDataFrame([(n, "X", 1) for n in ("f", "É", "e", "Caching", "C++", "c", "C#", "C", "CI/CD", ".NET")] + [("z", "X", 2)], "name string, category string, n long")
    assert [r["name"] for r in pages.rank_keywords(found).collect()] == ["z", ".NET", "c", "C", "C#", "C++", "Caching", "CI/CD", "e", "É", "f"]


def test_terms_by_profile(spark):
    found = spark.createDataFrame([(1, "SQL"), (1, "Go"), (2, "Go")], "doc_id long, name string")
    rows = pages.split_by_profile(found, spark.createDataFrame([("Go",), ("Go",), ("R",)], "name string")).collect()
    assert sorted((r["doc_id"], r["name"], r["have"]) for r in rows) == [(1, "Go", True), (1, "SQL", False), (2, "Go", True)]


def test_postings_in_graphs_of_any_depth(spark):
    def block(x):
        return '<script type="application/ld+json">' + (x if isinstance(x, str) else json.dumps(x)) + "</script>"

    def job(title):
        return {"@type": "JobPosting", "title": title}

    deep = job("deep")
    for _ in range(12):
        deep = {"@graph": [{"@type": "X"}, [deep], job("too late")]}
    cases = [
        (block(deep) + block(job("later")), "deep"), (block([[[{"@graph": [job("a")]}, job("b")]]]), "a"), (block("{bad [") + block(job("ok")), "ok"), (block({"@graph": job("single")}), "single"),
        (block([{"@type": "A", "@graph": [[job("g")]]}, job("c")]), "g"), (block({"@type": ["Thing", "JobPosting"], "title": "list"}), "list"), (block("[]"), None), ("", None), (None, None), (block({"x": job("hidden")}), None),
        (block([job("outer") | {"@graph": [job("inner")]}]), "outer"),
    ]
    df = spark.createDataFrame([(i, "https://x.com/a", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    assert [r["title"] for r in pages.detect_job_pages(df).orderBy("page_id").collect()] == [t for _, t in cases]


def test_rule_table_equals_trying_every_rule(spark):
    rng = random.Random(4)
    words = ["tax", "web", "data", "intern", "software", "engineer", "ops", "co-op", "Ünit", "c++"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(150)] + ["", None, "ab"]
    patterns = [r"(?i)\bTAX\b", r"(?i)(web|data) intern", r"soft\w+ eng", r"^ab$", r"^.?$", r"(?i)(?:ops){1,2}$", r"(?i)ünit", r"(?:co-op|c\+\+)", r"(?=.*tax)(?=.*web)", r"(?:intern)?", r"[wx]eb", r"eng(ineer|x)", r"\p{Lu}nit", r"(?i)ENGINEER (co-op|tax|ops|web) "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)] + [(1000, titles[0])], "posting_id long, title string")
    table = spark.createDataFrame([("l", i, p) for i, p in enumerate(patterns)] + [("l", 99, None)], "list string, ord int, pattern string")
    got = sorted((r["posting_id"], r["ord"]) for r in rules.match_rule_table(df, table).collect())
    tried = df.crossJoin(F.broadcast(table)).where(F.expr("title rlike pattern"))  # of small tables
    assert got == sorted((r["posting_id"], r["ord"]) for r in tried.collect()) and len(got) > 200
    many = spark.createDataFrame([("l", i, rf"(?i)word{i}\b") for i in range(10_000)], "list string, ord int, pattern string")
    hits = rules.match_rule_table(spark.createDataFrame([(i, f"a Word{i * 7} b") for i in range(300)], "posting_id long, title string"), many)
    assert sorted((r["posting_id"], r["ord"]) for r in hits.collect()) == [(i, 7 * i) for i in range(300)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "word77" not in plan


def packed_in_turn(sizes, limit, overhead, tries):
    """Parts of entries in order, each as (start, end)."""
    n = len(sizes)
    least = max(1, math.ceil((sum(sizes) + overhead) / limit))
    for parts in range(least, least + tries + 1):
        step = math.ceil(n / parts)
        runs = [(a, min(a + step, n)) for a in range(0, n, step)]
        if all(sum(sizes[a:b]) + overhead <= limit for a, b in runs):
            return runs
    out = []
    while runs:
        a, b = runs.pop(0)
        if b - a > 1 and sum(sizes[a:b]) + overhead > limit:
            mid = (a + b + 1) // 2
            runs[:0] = [(a, mid), (mid, b)]
        else:
            out.append((a, b))
    return out


def test_parts_equal_packing_in_turn(spark, monkeypatch):
    monkeypatch.setattr(digest, "BLOCK", 7)  # so that cuts lie within, at the ends of and beyond blocks
    rng = random.Random(6)
    digests = {f"d{k}": [rng.choice([5, 20, 20, 60, 400 if k % 3 == 0 else 30]) for _ in range(rng.choice([1, 6, 7, 8, 40, 150]))] for k in range(24)}
    rows = [(d, 1000 * k + i, i + 1, size) for k, (d, sizes) in enumerate(digests.items()) for i, size in enumerate(sizes)] + [(None, 1, 1, 10)]
    got = {}
    for r in digest.pack(spark.createDataFrame(rows, "digest_id string, posting_id long, rank int, size int"), limit=300, overhead=20, tries=3).collect():
        got.setdefault(r["digest_id"], []).append((r["rank"], r["part_no"], r["parts"]))
    assert set(got) == set(digests)
    for d, sizes in digests.items():
        runs = packed_in_turn(sizes, 300, 20, 3)
        assert sorted(got[d]) == [(i + 1, k + 1, len(runs)) for k, (a, b) in enumerate(runs) for i in range(a, b)]


def test_counts_are_taken_while_rows_pass(spark, tmp_path):
    tally = audit.Tally()
    evens = tally(tally(spark.range(10), "all").where("id % 2 = 0"), "even")
    evens.write.parquet(str(tmp_path / "t"))
    assert (tally["all"], tally["even"]) == (10, 5)


def test_state_of_a_stream_falls_behind_the_watermark(spark, tmp_path):
    held, sent = [], []
    for turn, day in enumerate((1, 2, 20, 21)):
        spark.sql(f"SELECT id + {0 if turn == 3 else turn * 1000} AS event_id, timestamp'2024-01-{day:02d} 00:00:00' AS ts FROM range(100)").write.mode("append").parquet(str(tmp_path / "feed"))
        once = dedup_within(spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "feed")), "event_id", "ts", stream_queries.TTL)
        run = once.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
        sent.append(spark.read.schema("event_id long, ts timestamp").parquet(str(tmp_path / "out")).count())
    assert held[1] == 200 and held[2] < 300 and held[3] <= 200  # keys of the first days are gone
    assert sent == [100, 200, 300, 400]  # ids of the first day, no longer known, pass again


def test_roles_of_several_cities(spark):
    shape = "ord long, posting_id long, company string, title string, season string, source string, location string"
    rows = [(1, 11, "Acme", "SWE Intern", "S", "a", "Boston"), (2, 12, "ACME", "swe intern", "s", "a", "Austin, TX +3"), (3, 13, "acme", "SWE Intern", "S", "a", "Boston"), (4, 14, "Acme", "SWE Intern", "S", "b", ""), (5, 15, None, "SWE Intern", "S", "a", "X"), (5, 16, "", "SWE Intern", "S", "a", None)]
    roles, members = digest.group_same_role(spark.createDataFrame(rows, shape))
    found = {r["posting_id"]: r for r in roles.collect()}
    assert {i: (r["company"], r["n"], r["places"]) for i, r in found.items()} == {11: ("Acme", 3, "Boston; Austin, TX"), 14: ("Acme", 1, ""), 15: (None, 1, "X"), 16: ("", 1, "")}
    held = {}
    for r in members.collect():
        held.setdefault(r["role"], set()).add(r["posting_id"])
    assert {i: held[r["role"]] for i, r in found.items()} == {11: {11, 12, 13}, 14: {14}, 15: {15}, 16: {16}}
    assert digest.group_same_role(spark.createDataFrame([], shape))[0].count() == 0


def test_a_broken_file_fails_its_own_feed(spark, tmp_path):
    record = {"active": True, "is_visible": True, "category": "SWE", "terms": ["Summer 2027"], "locations": ["Austin, TX"], "url": "https://x.org/1", "company_name": "C", "title": "Intern", "id": "1", "date_posted": 86400}
    files = {"good/a.json": [record, record | {"title": "Second"}], "good/b.json": [], "cut/a.json": [record], "object/a.json": {"a": 1}, "odd names/ä b.json": [record | {"unknown": 3, "locations": None, "terms": None}]}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body)[: -1 if name == "cut/a.json" else None])
    (tmp_path / "empty").mkdir()
    sources = [(name, str(tmp_path / name)) for name in ("good", "cut", "object", "odd names", "empty", "none")]
    postings, runs = feeds.read_feeds(spark, sources)
    assert [(r["source"], r["title"], r["pos"] & 0xFFFFFFFF) for r in postings.orderBy("source_rank", "pos").collect()] == [("good", "Intern", 0), ("good", "Second", 1), ("odd names", "Intern", 0)]
    assert {r["source"]: (r["ok"], r["error"]) for r in runs.collect()} == {"good": (True, ""), "cut": (False, "a file is no JSON list"), "object": (False, "a file is no JSON list"), "odd names": (True, ""), "empty": (False, "no file"), "none": (False, "no file")}
    none, runs = feeds.read_feeds(spark, sources[-1:])
    assert none.count() == 0 and runs.first()["ok"] is False


def changed(tmp_path, **tables):
    """The smallest tables, some of them as a SELECT from `old` says."""
    for name in os.listdir(SF):
        select = tables.get(name.removesuffix(".parquet"))
        if select is None:
            os.symlink(f"{SF}/{name}", tmp_path / name)
        else:
            duckdb.sql(f"COPY (WITH old AS (SELECT * FROM '{SF}/{name}') {select}) TO '{tmp_path / name}'")
    return str(tmp_path)


def differs(spark, name, folder):
    """Rows by which a query and its SQL differ."""
    with duckdb.connect() as db:
        for table in os.listdir(folder):
            db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}'")
        want = db.execute(SQL[name])
        columns = [c[0] for c in want.description]
        return {*map(tuple, QUERIES[name](spark, folder).select(columns).collect())} ^ {*want.fetchall()}


@pytest.mark.parametrize("name", ["digest_parts", "digest_bodies"])
def test_parts_that_no_number_fits_equal_the_sql(spark, tmp_path, name):
    long = "SELECT * REPLACE (s_name || CASE WHEN s_suppkey % 10 = 9 THEN repeat('x', 40000) ELSE '' END AS s_name) FROM old"
    assert differs(spark, name, changed(tmp_path, supplier=long)) == set()


def test_parts_are_halved_unless_told_not_to(spark):
    sizes = [400] * 500 + [4000] * 100  # the large ones fill their parts at any number that is tried
    rows = spark.createDataFrame([("d", i, i + 1, n) for i, n in enumerate(sizes)], "digest_id string, posting_id long, rank int, size int")
    even, halved = ([len(sizes[r["a"] : r["b"]]) and (r["a"], r["b"]) for r in digest.pack(rows, halve=h).groupBy("part_no").agg((F.min("rank") - 1).alias("a"), F.max("rank").alias("b")).orderBy("part_no").collect()] for h in (False, True))
    assert max(sum(sizes[a:b]) + 2000 for a, b in halved) <= 92_000 < max(sum(sizes[a:b]) + 2000 for a, b in even)
    assert len({b - a for a, b in even[:-1]}) == 1 and [x for a, b in halved for x in range(a, b)] == list(range(600))


def test_clusters_carry_only_what_they_need(spark):
    """What clustering writes doesn't grow with columns that it doesn't use."""
    folder = checkpoint_folder(spark).removeprefix("file:")
    rows = keys.with_keys(postings_view(spark, SF).limit(500)).withColumn("note", F.repeat(F.col("apply_url"), F.lit(200)))
    held = sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names)
    assert cluster(rows)[0].agg(F.sum("n_members")).first()[0] == 500
    assert sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names) - held < 1_000_000


def test_postings_are_judged_once(spark):
    plan = rules.tag(postings_view(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)outreachy") == 1


def test_names_without_words_equal_patterns(spark):
    rng = random.Random(5)
    words = ["Inc", "inc.", "Co-op", "coop", "New", "new grad", "NEWGRAD", "graduate", "new  graduate", "2027", "20271", "1999", "2\u0660\u0661\u0662", "Summer", "bachelors", "Under-grad", "the", "AG", "ag1", "Zoë", "K\u212a", "İ", "\n", "\t", "_", "news", "renew grad", ""]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", "  ", "", "/", ", "]) for _ in range(rng.randrange(7))) for _ in range(600)] + [None]
    company = r"\b(inc|llc|ltd|corp|corporation|co|company|technologies|technology|labs|group|holdings|plc|gmbh|sa|ag|nv|the)\b"

    def plain(text, pattern):
        text = re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip()
        return " ".join(re.sub(pattern, " ", text).split())

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keys.normalize_company("t").alias("c"), keys.normalize_title("t").alias("n"))
    assert [tuple(r) for r in df.collect() if (r["c"], r["n"]) != (plain(r["t"], company), plain(r["t"], keys.TITLE_WORDS))] == []
