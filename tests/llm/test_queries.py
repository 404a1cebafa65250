"""The digest queries and the pipeline against brute force over whole tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingflow.llm import fingerprints, lm_scoring, queries
from listingflow.llm.order_minhash import near_duplicates
from listingflow.llm.quality_classifier import score_quality
from listingflow.llm.sharding import jump
from listingflow.llm.wording import hashed_words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def without_passages(texts):
    """Words and whether each goes, per text."""
    words = {i: WORD.findall(t) for i, t in texts.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    gone = {}
    for i, w in words.items():
        gone[i] = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[i][k : k + 35] = True
    return words, gone


def test_op1_covers_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own, taken = {}, {}
    for r in rows_of(spark, "op1_packing"):
        own.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        taken[r["sequence_id"]] = taken.get(r["sequence_id"], 0) + r["length"]
    assert set(own) == set(texts) and max(taken.values()) <= 2048
    assert sum(taken.values()) > 0.97 * 2048 * len(taken)
    for i, text in texts.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc, total in sorted(own[i]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)


def test_op3_equals_brute_force(spark, texts):
    words, gone = without_passages(texts)
    want = sorted((i, len(w), int(gone[i].sum()), sha(" ".join(x for x, g in zip(w, gone[i]) if not g).encode())) for i, w in words.items())
    assert sorted(map(tuple, rows_of(spark, "op3_substring_dedup"))) == want


def test_op2_measures_and_verdicts_equal_brute_force(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    langs = {r["doc_id"]: r["lang"] or "" for r in docs.select("doc_id", "lang").collect()}
    toxic_of = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IS NOT NULL").collect()}
    seen = {}
    for i, t in texts.items():
        if i in toxic_of:
            for term in {w.strip(".,;:!?\"'()").lower() for w in WORD.findall(t)}:
                seen.setdefault((langs[i], term), [0, 0])[toxic_of[i]] += 1
    toxic = {k for k, (clean, bad) in seen.items() if k[1] and bad >= 3 and bad >= 20 * clean}
    assert len(toxic) < 4096
    for r in rows_of(spark, "op2_quality_rules"):
        t, w = texts[r["doc_id"]], WORD.findall(texts[r["doc_id"]])
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
        assert tuple(r)[:6] == (r["doc_id"], len(w), chars, symbols, dup, len(again))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        letters, upper = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
        hits = sum((langs[r["doc_id"]], x.strip(".,;:!?\"'()").lower()) in toxic for x in w)
        refused = symbols > 0.1 * len(w) or chars > 20 * len(w) or upper > 0.3 * letters or letters < 0.5 * chars or 2 * dup > len(lines) or (hits >= 2 and 500 * hits >= len(w))
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not refused)


def test_op5_score_equals_brute_force(spark, texts):
    pieces, scores = lm_scoring.vocabulary(P.path("piece_bpe_32k.model"))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [w.encode() for w in WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t))] for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    longest, rank = max(map(len, pieces)), dict(zip(pieces, scores.tolist()))

    def logs(words, exponent):
        norm = sum((10.0 - s) ** -exponent for s in rank.values())
        p = {k: 0.7 * (10.0 - s) ** -exponent / norm for k, s in rank.items()}
        out = {}
        for w in words:
            a = [1.0] + [0.0] * len(w)
            for e in range(1, len(w) + 1):
                a[e] = sum(a[b] * p[w[b:e]] for b in range(max(0, e - longest), e) if w[b:e] in p)
            out[w] = math.log10(a[-1] * 0.3)
        return out

    best = max(lm_scoring.EXPONENTS, key=lambda e: sum(n * lp for n, lp in zip(c.values(), logs(c, e).values())))
    lp = logs({w for t in tokens.values() for w in t}, best)
    for r in rows_of(spark, "op5_lm_scoring"):
        assert r["score"] == pytest.approx(sum(lp[w] for w in tokens[r["doc_id"]]) + math.log10(0.3), rel=1e-6)


def test_op5_base_equals_brute_force(spark, texts):
    tokens = {i: [*WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t)), " "] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = rows_of(spark, "op5_lm_scoring")
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9) and r["score"] < 0


def test_op6_follows_jump_hash(spark, texts):
    rows = rows_of(spark, "op6_sharding")
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items())
    for shard in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    def scalar(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    keys = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in texts}
    for r in rows:
        assert (r["law"], r["shard"], r["grown_shard"]) == ("key", scalar(keys[r["doc_id"]], 40), scalar(keys[r["doc_id"]], 41))
    assert jump(np.zeros(1, np.uint64), 1)[0] == 0


def test_op7_equals_the_library(spark, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts.items():
        ids = np.array(e.encode_ordinary(t), "<u4")
        want.append((i, len(ids), sha(ids.tobytes()), sha(t.encode())))
    assert sorted(map(tuple, rows_of(spark, "op7_bpe"))) == sorted(want)


def test_op8_equals_brute_force(spark, texts):
    seen, want = set(), []
    for i, t in sorted((i, t.encode()) for i, t in texts.items()):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if t[k : k + 50] in seen:
                gone[k : k + 50] = True
        seen |= {t[k : k + 50] for k in range(len(t) - 49)}
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        want.append((i, len(t), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), sha(kept)))
    assert sorted(map(tuple, rows_of(spark, "op8_suffix_dedup"))) == sorted(want)


def test_op9_classes_equal_brute_force(spark, texts):
    """Links by alignment alone: of all pairs those are tried whose words in common don't rule it out."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    ids, words = sorted(texts), {i: WORD.findall(t) for i, t in texts.items()}
    counts = {i: Counter(w) for i, w in words.items()}
    home = {i: i for i in ids}
    for a in ids:
        for b in ids:
            x, y = words[a], words[b]
            longer = max(len(x), len(y))
            if a < b and home[a] != home[b] and min(len(x), len(y)) >= longer - int(0.2 * longer + 1e-9) and sum((counts[a] & counts[b]).values()) >= 0.8 * longer - 1e-9:
                if x == y or edits(x, y) <= int(0.2 * max(longer, 1) + 1e-9):
                    low, high = sorted((home[a], home[b]))
                    home = {k: low if v == high else v for k, v in home.items()}
    assert dict(map(tuple, rows_of(spark, "op9_order_minhash"))) == home


def test_op10_edits(spark, texts):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    rows = {r["doc_id"]: r for r in rows_of(spark, "op10_fingerprints")}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        half = len(t) // 2
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == sha((t[: len(t) - half] + texts[after[i]][:half]).encode())

    def terms(t):
        return {numbers[w] for w in WORD.findall(t.lower())}

    vocabulary = sorted({w for t in texts.values() for half in (t, t[: len(t) - len(t) // 2], t[: len(t) // 2]) for w in WORD.findall(half.lower())} | {w for i, t in texts.items() for w in WORD.findall((t[: len(t) - len(t) // 2] + texts[after[i]][: len(t) // 2]).lower())})
    numbers = dict(zip(vocabulary, hashed_words([" ".join(vocabulary).encode()])[0].tolist()))

    df = Counter(x for t in texts.values() for x in terms(t))
    band = {x for x, n in df.items() if 2 <= n <= 0.2 * len(texts)}

    def mixed(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m % 2**64
        return x ^ x >> 33

    def signed(t):
        own = terms(t) & band
        few, used = not own, own or terms(t)
        out = []
        for seed, limit in zip(fingerprints._SEEDS.tolist(), fingerprints._LIMITS.tolist()):
            total = sum(h for x in used if (h := mixed(x ^ seed)) & 0xFFFFFFFF < limit or few) % 2**64
            out.append(1 if few and not total else mixed(total) >> 32)
        return out

    def alike(a, b):
        return 1.0 if a == b else sum(x == y for x, y in zip(a, b) if x or y) / max(1, sum(1 for x, y in zip(a, b) if x or y))

    for i in order[::2]:
        t, half = texts[i], len(texts[i]) // 2
        own, edited, other = signed(t), signed(t[: len(t) - half] + texts[after[i]][:half]), signed(texts[after[i]])
        assert rows[i]["fingerprint"] == "".join(f"{x:08x}" for x in own) and rows[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in edited)
        assert (rows[i]["near_edited"], rows[i]["near_next"]) == pytest.approx((alike(own, edited), alike(own, other)))


def test_classifier_on_held_out_labels(spark):
    rows = queries.op4_quality_classifier(spark, "/root/testdata/sf0.01")
    got = rows.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("quality IS NOT NULL").collect()
    good, bad = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9
    assert rows.count() == 1000 and rows.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a", 2.0), (None, None, 1.0), (1, "a", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in score_quality(docs, labels, F.lit(True)).collect()] == [0.5] * 3
    assert score_quality(docs.where("false"), labels, F.lit(True)).count() == 0


def test_pipeline_stages(spark, texts, tmp_path):
    rng = np.random.default_rng(5)
    extra = [" ".join(f"word{x}" for x in rng.integers(0, 900, 80)) for _ in range(2)]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, extra[0], None, None, None), (None, extra[1], None, None, None), (901, None, None, "s", 0), (902, "", "en", None, 0)]
    docs = spark.createDataFrame([*rows, rows[0], rows[1]], SCHEMA)
    own = {(i, t or "") for i, t, *_ in rows}
    stages = dict(corpus_pipeline.STAGES)

    scored = stages["quality_classifier"](spark, docs, SF)
    assert scored.columns == docs.columns and {tuple(r)[:2] for r in scored.collect()} <= {(i, t) for i, t, *_ in rows}
    ruled = stages["quality_rules"](spark, docs, SF).collect()
    assert {r["text"] for r in ruled} >= set(extra) and not {r["doc_id"] for r in ruled} & {901, 902}

    classes = {(r["doc_id"], bytes(r["digest"])): (r["class_id"], bytes(r["class_digest"])) for r in near_duplicates(docs).collect()}
    single = stages["near_dedup"](spark, docs, SF)
    kept = single.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node")).collect()
    assert len(kept) == len(set(classes.values())) and {(r["doc_id"], bytes(r["node"])) for r in kept} == set(classes.values())
    assert {(r["doc_id"], r["text"]) for r in kept} <= own and set(extra) <= {r["text"] for r in kept}

    numbered = dict(enumerate(t or "" for _, t, *_ in [*rows, rows[0], rows[1]]))
    words, gone = without_passages(numbered)
    want = sorted(" ".join(x for x, g in zip(w, gone[k]) if not g) if gone[k].any() else numbered[k] for k, w in words.items() if not gone[k].all())
    cut = stages["substring_dedup"](spark, docs, SF)
    assert cut.columns == docs.columns and sorted(r["text"] for r in cut.collect()) == want
    packed = stages["packing"](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()

    nothing = docs.where("false")
    assert all(stage(spark, nothing, SF).count() == 0 for stage in stages.values())


def test_pipeline_runs_on_whole_tables(spark, texts):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "length", "sequence_id").collect()
    assert rows and {r["doc_id"] for r in rows} <= set(texts)
    assert {i for i, t in texts.items() if len(WORD.findall(t)) < 50}.isdisjoint(r["doc_id"] for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    with duckdb.connect() as db:
        for table in ("documents", "labels", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = db.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(columns).collect())) == sorted(want.fetchall())
