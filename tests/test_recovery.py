"""Ledgers, streams, sources, migration and odd rows of the postings operators."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from listingflow.functions.keys import ATS_PATTERNS, LEGACY_PATTERNS, SIGNS, with_keys, with_legacy_keys
from listingflow.operators import audit, commits, digest, ledger, migrate, rules
from listingflow.operators.cluster import _merged, cluster, strip_ambiguous
from listingflow.schema import POSTINGS
from listingflow.sources import feeds
from listingflow.streaming import digest as stream

SF = "/root/testdata/sf0.001"


def posting(i, title="Software Engineer Intern", source="s0", url=None, company=None, uuid=""):
    return (i, source, 0, i, company or f"Company {i}", title, url or f"https://x.org/{i}", "Austin, TX", "Summer 2027", "", "", False, uuid, None)


def postings(spark, rows):
    return spark.createDataFrame(rows, POSTINGS)


def emitted(df):
    return sorted(r["rep"]["posting_id"] for r in df.collect())


def seen_of(spark, path, **how):
    return sorted(r["key"] for r in ledger.read_ledger(spark, path, **how)[0].collect())


def added(spark, path, key):
    keys = spark.createDataFrame([(key,)], "key string")
    return ledger.update_ledger(spark, path, lambda held: ledger.upsert_seen(held, keys, F.lit("2026-01-01T00:00:00")))


def test_ledger_is_a_first_run_if_missing(spark, tmp_path):
    path = str(tmp_path / "seen")
    rows, first = ledger.read_ledger(spark, path)
    assert first and rows.count() == 0
    ledger.write_ledger(spark.createDataFrame([("k", "2026-01-01T00:00:00")], ledger.SEEN), path)
    rows, first = ledger.read_ledger(spark, path)
    assert not first and [tuple(r) for r in rows.collect()] == [("k", "2026-01-01T00:00:00")]
    assert ledger.read_json_ledger(spark, str(tmp_path / "none.json"))[1]
    for text, want in (("{broken", True), (json.dumps({"seen": {"a": "b"}}), False)):
        (tmp_path / "l.json").write_text(text)
        assert ledger.read_json_ledger(spark, str(tmp_path / "l.json"))[1] is want
    assert ledger.read_applied(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("text", ["", "{", "[]", "{}", '{"snapshot": "none", "bytes": 1}', "gone", "cut"])
def test_a_commit_that_cannot_be_read_gives_way_to_an_older_one_or_raises(spark, tmp_path, text):
    path = str(tmp_path / "seen")
    for turn, key in enumerate("ab"):
        name = added(spark, path, key)
        pointer = tmp_path / "seen" / "pointers" / f"{turn + 1:012d}"
        if text == "gone":
            shutil.rmtree(os.path.join(path, name))
        elif text == "cut":
            part = next((tmp_path / "seen" / name).glob("*.parquet"))
            part.write_bytes(part.read_bytes()[:-1])
        else:
            pointer.write_text(text)
        if turn == 0:
            with pytest.raises(commits.LedgerDamaged):
                ledger.read_ledger(spark, path)
            with pytest.raises(commits.LedgerDamaged):
                added(spark, path, "x")  # what was sent isn't known, so nothing may be recorded in its stead
            assert ledger.read_ledger(spark, path, damaged="first run")[1] and ledger.read_applied(spark, path).count() == 0
            shutil.rmtree(path)
            added(spark, path, "old")
    assert seen_of(spark, path) == ["old"]
    added(spark, path, "c")
    assert seen_of(spark, path) == ["c", "old"]


@pytest.mark.parametrize("stop", ["snapshot", "named aside", "written aside", "put"])
def test_a_writer_that_stops_anywhere_loses_nothing(spark, tmp_path, monkeypatch, stop):
    path = str(tmp_path / "seen")
    added(spark, path, "a")

    def stopped(*_):
        raise OSError("stopped")

    real = {f: getattr(commits, f) for f in ("_write_aside", "_put")}
    with monkeypatch.context() as m:
        if stop == "snapshot":
            m.setattr(commits, "_write_aside", stopped)
        elif stop == "named aside":
            m.setattr(commits, "_write_aside", lambda *_: (tmp_path / "seen" / "pointers" / ".half").write_text('{"snap') and stopped())
        elif stop == "written aside":
            m.setattr(commits, "_put", stopped)
        else:
            m.setattr(commits, "_put", lambda *args: real["_put"](*args) and stopped())
        with pytest.raises(OSError):
            added(spark, path, "b")
    assert seen_of(spark, path) == (["a", "b"] if stop == "put" else ["a"])
    added(spark, path, "b")
    assert seen_of(spark, path) == ["a", "b"]


@pytest.mark.parametrize("scheme", ["link", "rename"])
def test_of_two_writers_none_loses_a_key(spark, tmp_path, monkeypatch, scheme):
    path = str(tmp_path / "seen")
    if scheme == "rename":  # the way of file systems that aren't local
        real = commits._put

        def put(spark, aside, path, number):
            fs, files, source = commits._hadoop(spark, aside)
            context = fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            target = files.makeQualified(fs.Path(f"{path}/pointers/{number:012d}"))
            if files.exists(target):
                return real(spark, aside, path, number)
            context.rename(source, target, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True

        monkeypatch.setattr(commits, "_put", put)
    others = iter("xyz")

    def change(held):
        other = next(others, None)
        if other:  # another writer commits between this one's reading and its commit
            added(spark, path, other)
        return ledger.upsert_seen(held, spark.createDataFrame([("a",)], "key string"), F.lit("2026-01-01T00:00:00"))

    ledger.update_ledger(spark, path, change)
    assert seen_of(spark, path) == ["a", "x", "y", "z"]
    assert not [f for f in (tmp_path / "seen" / "pointers").glob(".*") if not f.name.endswith(".crc")]
    assert commits.expire(spark, path, keep=1) == 3 and seen_of(spark, path) == ["a", "x", "y", "z"]
    assert len(list((tmp_path / "seen").glob("v=*"))) == 1


def marks_in_turn(stored, marks):
    """The store's ledger after marks one by one: keys to records that keys share."""
    records = {k: dict(v) for k, v in stored.items()}
    for m in marks:
        record = next((records[k] for k in m["keys"] if k in records), None)
        if record is None:
            record = {c: m[c] for c in ("applied_at", "url", "company", "title")}
        for c in ("company", "title"):
            record[c] = record[c] or m[c]
        for k in m["keys"]:
            records[k] = record
    return {k: tuple(r[c] for c in ("applied_at", "url", "company", "title")) for k, r in records.items()}


@pytest.mark.parametrize("seed", range(4))
def test_marks_of_many_keys_equal_a_store_that_takes_them_in_turn(spark, seed):
    rng = random.Random(seed)
    pool = [f"k{i}" for i in range(60)]
    stored = {k: {"applied_at": "2025", "url": f"u{k}", "company": rng.choice(["", "s"]), "title": ""} for k in rng.sample(pool, 12)}
    marks = [{"keys": rng.sample(pool, rng.randrange(1, 4)) + ["hot"] * (rng.random() < 0.2), "applied_at": f"2026-{i:04d}", "url": f"m{i}", "company": rng.choice(["", f"c{i}"]), "title": rng.choice(["", "", f"t{i}"])} for i in range(50)]
    ledger_rows = spark.createDataFrame([(k, *(v[c] for c in ("applied_at", "url", "company", "title"))) for k, v in stored.items()], ledger.APPLIED)
    table = spark.createDataFrame([(m["keys"], m["applied_at"], m["url"], m["company"], m["title"]) for m in marks], "keys array<string>, applied_at string, url string, company string, title string")
    got = {r["key"]: tuple(r)[1:] for r in ledger.mark_applied(ledger_rows, table.union(table.limit(5))).collect()}
    assert got == marks_in_turn(stored, marks)


def test_marks_of_one_job(spark):
    stored = spark.createDataFrame([("k1", "2026-01-01", "u1", None, "")], ledger.APPLIED)
    shape = "keys array<string>, applied_at string, url string, company string, title string"
    marks = spark.createDataFrame([(["k1", "k2"], "2026-02-02", "m", "Acme", ""), (["n"], "2026-02-03", "n1", "", None), (["n"], "2026-02-04", "n2", "Named", ""), ([], "2026", "", "", ""), (None, "2026", "", "", "")], shape)
    got = {r["key"]: tuple(r)[1:] for r in ledger.mark_applied(stored, marks).collect()}
    assert got == {"k1": ("2026-01-01", "u1", "Acme", ""), "k2": ("2026-01-01", "u1", "Acme", ""), "n": ("2026-02-03", "n1", "Named", "")}
    assert ledger.mark_applied(stored.limit(0), marks.limit(0)).count() == 0


@pytest.mark.parametrize("crash", ["keys", "output", "ledger"])
def test_a_batch_that_stops_anywhere_is_sent_once(spark, tmp_path, monkeypatch, crash):
    state = str(tmp_path)
    assert stream.run_batch(postings(spark, [posting(0)]), 0, state).count() == 0  # the first run only records
    batch = postings(spark, [posting(0), posting(1), posting(2)])
    real = stream.update_ledger
    if crash == "ledger":
        monkeypatch.setattr(stream, "update_ledger", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            stream.run_batch(batch, 1, state)
        monkeypatch.setattr(stream, "update_ledger", real)
    elif crash == "output":  # the keys are written, and the output, but for its success mark
        stream.run_batch(batch, 1, state)
        os.remove(tmp_path / "batches" / "batch=1" / "_SUCCESS")
        max((tmp_path / "seen" / "pointers").glob("0*")).unlink()
    else:  # only the keys are written
        spark.createDataFrame([("url:x.org/9", "2026-01-01T00:00:00")], ledger.SEEN).write.parquet(f"{state}/batches/batch=1.keys")
    assert emitted(stream.run_batch(batch, 1, state)) == [1, 2]
    assert emitted(stream.run_batch(batch, 1, state)) == [1, 2]  # the same batch again
    assert emitted(stream.run_batch(postings(spark, [posting(1), posting(2), posting(3)]), 2, state)) == [3]


def test_failed_sources_and_dropped_postings_are_not_recorded(spark, tmp_path):
    state = str(tmp_path)
    stream.run_batch(postings(spark, [posting(0)]), 0, state)
    batch = postings(spark, [posting(1), posting(2, source="s1"), posting(3, title="Summer of Code Intern"), posting(4, title="Tax Intern")])
    runs = spark.createDataFrame([("s0", 0, True, ""), ("s1", 1, False, "down")], "source string, source_rank int, ok boolean, error string")
    assert emitted(stream.run_batch(batch, 1, state, runs)) == [1, 4]
    keys = {r["key"] for r in ledger.read_ledger(spark, f"{state}/seen")[0].collect()}
    assert "url:x.org/4" in keys and not keys & {"url:x.org/2", "url:x.org/3"}
    assert emitted(stream.run_batch(batch, 2, state)) == [2]


def test_stream_of_postings_is_sent_once(spark, tmp_path):
    feed = tmp_path / "feed"
    postings(spark, [posting(0)]).write.parquet(str(feed / "a"))
    for turn, rows in enumerate(([posting(0)], [posting(0), posting(5)], [posting(5), posting(6)])):
        postings(spark, rows).coalesce(1).write.mode("append").parquet(str(feed / "all"))
        source = spark.readStream.schema(POSTINGS).parquet(str(feed / "all"))
        query = stream.start(source, str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    sent = spark.read.parquet(str(tmp_path / "state" / "batches" / "batch=*[0-9]"))
    assert emitted(sent) == [5, 6]


def test_delivery_stops_at_the_first_failed_part(spark):
    seen = spark.createDataFrame([("old", "2025-01-01T00:00:00")], ledger.SEEN)
    parts = spark.createDataFrame([("d", k, f"k{k}") for k in (1, 2, 3)] + [("e", 1, "e1")], "digest_id string, part_no int, key string")
    status = spark.createDataFrame([("d", 1, True), ("d", 2, False), ("d", 3, True), ("e", 1, True)], "digest_id string, part_no int, ok boolean")
    got = {r["key"] for r in stream.commit_delivered(seen, parts, status, F.lit("2026-01-01T00:00:00")).collect()}
    assert got == {"old", "k1", "e1"}


def test_migration(spark):
    clusters = spark.createDataFrame([(1, ["new1", "id1"]), (2, ["new2"]), (3, ["new3"])], "cluster_id long, keys array<string>")
    legacy = spark.createDataFrame([(1, ["old1"]), (2, ["old2", "both"]), (3, ["both", "gone"])], "cluster_id long, legacy_keys array<string>")
    seen = spark.createDataFrame([("old1", "2026-01-01"), ("both", "2026-01-02"), ("other", "2026-01-03")], ledger.SEEN)
    after, report, poisoned = migrate.migrate(seen, clusters, legacy)
    stored = {r["key"]: r["first_seen"] for r in after.collect()}
    assert stored == {"old1": "2026-01-01", "both": "2026-01-02", "other": "2026-01-03", "new1": "2026-01-01", "id1": "2026-01-01"}
    assert tuple(report.first()) == (2, 1, 3, 2, 0) and [tuple(r) for r in migrate.worst_keys(poisoned).collect()] == [("both", 2)]
    again, second, _ = migrate.migrate(after, clusters, legacy)
    assert second.first()["written"] == 0 and {r["key"] for r in again.collect()} == set(stored)  # nothing more the second time
    same, preview, _ = migrate.migrate(seen, clusters, legacy, apply=False)
    assert preview.first()["written"] == 2 and same.count() == 3
    runs = spark.createDataFrame([("a", True, ""), ("b", False, "down")], "source string, ok boolean, error string")
    with pytest.raises(migrate.SourcesFailed, match="b"):
        migrate.migrate(seen, clusters, legacy, runs=runs)
    assert tuple(migrate.migrate(seen.where("false"), clusters.where("false"), legacy.where("false"))[1].first()) == (0, 0, 0, 0, 0)


def test_rules_of_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"block_title": [r"\bbarista\b"], "maybe_title": [r"\bsales\b"]}))
    lists = feeds.load_rules(spark, str(path))
    df = postings(spark, [posting(1, "Barista"), posting(2, "Sales Intern"), posting(3, "Summer of Code"), posting(4, None)])
    got = {r["posting_id"]: r["verdict"]["action"] for r in rules.judge(df, lists).collect()}
    assert got == {1: "drop", 2: "maybe", 3: "keep", 4: "keep"}
    path.write_text(json.dumps({"maybe_title": ["(broken"]}))
    with pytest.raises(ValueError, match=r"maybe_title.*\(broken"):
        feeds.load_rules(spark, str(path))
    path.write_text("no rules")
    with pytest.raises(ValueError):
        feeds.load_rules(spark, str(path))
    assert feeds.load_rules(spark) is rules.RULES


def test_feeds_that_are_no_lists(spark, tmp_path):
    for name, text in (("object.json", '{"a": 1}'), ("empty.json", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            feeds.read_feed(spark, str(tmp_path / name))
    (tmp_path / "other.json").write_text('{"schema": 2, "sources": []}')
    with pytest.raises(ValueError):
        feeds.load_corpus(spark, str(tmp_path / "other.json"))


def test_legacy_scheme_stands_by_itself():
    assert len(LEGACY_PATTERNS) == 18 and {s[1] for s in LEGACY_PATTERNS} | {s[1] for s in ATS_PATTERNS} == set(SIGNS)


def test_clusters_equal_a_sequential_pass(spark):
    rows = with_keys(entry.posting_queries.postings_view(spark, SF))
    clusters, stats, unusable, placed = cluster(rows)
    own = {r["posting_id"]: (r["pos"], r["keys"], r["employer_key"], r["indirect"], r["source"], r["source_rank"]) for r in rows.dropDuplicates(["posting_id"]).collect()}
    if rows.count() != len(own):
        rows = rows.dropDuplicates(["posting_id"]).persist()
        own = {r["posting_id"]: (r["pos"], r["keys"], r["employer_key"], r["indirect"], r["source"], r["source_rank"]) for r in rows.collect()}
        clusters, stats, unusable, placed = cluster(rows)
    late = {v[4] for v in own.values() if v[3]}
    order = sorted(own, key=lambda i: (own[i][4] in late, own[i][5], own[i][0]))
    home, holder = {}, {}
    place = {i: n for n, i in enumerate(order)}
    parent = dict.fromkeys(order)

    def find(i):
        while parent[i] is not None:
            i = parent[i]
        return i

    for i in order:
        for key in own[i][1]:
            if not key.startswith("id:"):
                a, b = find(i), find(holder.setdefault(key, i))
                if a != b:
                    low, high = sorted((a, b), key=place.get)
                    parent[high] = low
    groups = {}
    for i in order:
        groups.setdefault(find(i), []).append(i)
    strong = {place[r]: next((own[i][2] for i in members if own[i][2]), "") for r, members in groups.items()}
    turns = {}
    for r, members in groups.items():
        for i in members:
            for key in own[i][1]:
                if key.startswith("id:"):
                    turns.setdefault(key, {})[place[r]] = None
    merged = _merged((sorted(m) for _, m in sorted(((k, list(m)) for k, m in turns.items()), key=lambda kv: (min(kv[1]), kv[0]))), strong)
    want = {}
    for r, members in groups.items():
        want.setdefault(merged[place[r]], set()).update(members)
    got = {}
    for r in placed.collect():
        got.setdefault(r["cluster_id"], []).append(r["posting_id"])
    assert {r["cluster_id"]: r["n_members"] for r in clusters.collect()} == {k: len(v) for k, v in got.items()}
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert stats.first()["clusters"] == len(want) and unusable.count() == 0
    assert home == {} and strip_ambiguous(clusters).where("size(keys) = 0").count() == 0


def test_odd_postings_have_defined_results(spark):
    """Null fields are empty, rows that repeat stand by themselves, empty tables give no rows."""
    rows = [posting(1), posting(1), (2, None, None, None, None, None, None, None, None, None, None, None, None, None), posting(3, title="", company="")]
    df = postings(spark, rows)
    keyed = with_legacy_keys(with_keys(df)).collect()
    assert len(keyed) == 4 and next(r for r in keyed if r["posting_id"] == 2)["keys"] == []
    for table in (df, df.where("false")):
        judged = rules.judge(table)
        assert judged.count() == table.count() and judged.where("verdict.action IS NULL").count() == 0
        assert rules.audit_summary(judged).first()["judged"] == table.count()
        assert audit.stratified_sample(table.withColumn("ord", F.col("pos")), 2).count() == min(2, table.count())
        ranked = digest.order_digest(rules.tag(table).withColumns({"digest_id": F.lit("d"), "ord": F.col("pos")}))
        assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, table.count() + 1))
        packed = digest.pack(ranked.select("digest_id", "posting_id", "rank", F.lit(50_000).alias("size")))
        assert [r["part_no"] for r in packed.orderBy("rank").collect()] == list(range(1, table.count() + 1))
    empty = spark.createDataFrame([], "query_id string, keys array<string>, id_prefix string")
    assert ledger.lookup(empty, spark.createDataFrame([], ledger.SEEN), spark.createDataFrame([], ledger.APPLIED)).count() == 0


def test_report_body(spark):
    entry_ = "digest_id string, part_no int, rank int, relevance string, relevance_rule string, indirect boolean, company string, title string, season string, source string, location string, salary string, apply_url string"
    rows = [
        ("d", 1, 1, "keep", "", False, "Acme", "SWE Intern", "Summer 2027", "s", "Austin, TX +2", "-", "u1"),
        ("d", 1, 2, "keep", "", False, "ACME", "SWE Intern", "Summer 2027", "s", "Boston", "", "u2"),
        ("d", 1, 3, "keep", "", True, "Beta", "Data Intern", None, "s", None, "$20/hr", "u3"),
        ("d", 1, 4, "maybe", "maybe_title", False, "Gamma", "Tax Intern", "n/a", "s", "", None, "u4"),
    ]
    body = digest.render_text(spark.createDataFrame(rows, entry_)).first()["body"]
    assert body == (
        "== Direct Apply (2) ==\n\nAcme - SWE Intern\n  Austin, TX, Boston | Summer 2027\n  [Austin, TX] u1\n  [Boston] u2\n\n"
        "== LinkedIn (opens on LinkedIn) (1) ==\n\nBeta - Data Intern\n  $20/hr\n  u3\n\n"
        "== Maybe (off-domain or restricted -- review) (1) ==\n\nGamma - Tax Intern\n  filtered: maybe_title\n  u4"
    )


def test_entry_lives_without_training_data(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert len(entry.queries()) > 40 and set(entry.oracle_sql()) <= set(entry.queries())

    def without_a_wheel(name):
        raise ModuleNotFoundError("no such wheel", name="tokenizers")

    monkeypatch.setattr(entry.importlib, "import_module", without_a_wheel)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
