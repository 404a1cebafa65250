"""Training-data operators on small fixtures with nulls, empty texts, ties and clashing columns."""


import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from listingflow.llm import anchors, bpe, fingerprints, order_minhash, packing, quality_rules, sharding, substring_dedup, suffix_dedup
from listingflow.llm.lm_scoring import Lattice, score_texts
from listingflow.llm.quality_classifier import FILTERS, SEGMENT, WIDTH, Network, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BODY = " ".join(f"w{i}" for i in range(60))
NEAR = BODY.replace("w30 ", "other ")
TEXTS = [(1, BODY), (2, BODY), (3, "x " + BODY + " y"), (4, NEAR), (5, None), (6, ""), (7, "tiny"), (None, BODY), (7, "tiny"), (8, "a  b\n\n é\t日本 <|endoftext|>" * 40)]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, DOCS).withColumns({"shard": F.lit(1), "range": F.lit(2), "key": F.lit("k"), "node": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing(docs, empty):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), capacity=64, piece=16).collect()
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0
    by_sequence, tokens = {}, 0
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        tokens += r["length"]
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in TEXTS)
    assert tokens == expected
    own = b"".join(r["ids"] for r in sorted((r for r in rows if r["doc_id"] == 8), key=lambda r: r["start"]))
    assert np.frombuffer(own, "<u4")[:-1].tolist() == t.encode(TEXTS[-1][1], add_special_tokens=False).ids


def test_rules(docs, empty):
    rows = quality_rules.apply_rules(docs).collect()
    assert len(rows) == len(TEXTS) and quality_rules.apply_rules(empty).count() == 0
    for r in rows:
        if r["doc_id"] == 8:
            words = WORD.findall(TEXTS[-1][1])
            grams = list(zip(words, words[1:], words[2:]))
            covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
            assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(words), len(covered), sum(map(len, words)))
        if r["doc_id"] in (5, 6):
            assert r["base_failed"] and not r["kept"] and r["n_words"] == 0


def test_toxic_terms_by_language(spark):
    def body(seed, n, extra=()):
        return " ".join([*(f"vocable{seed}word{i}" for i in range(n)), *extra])

    rows = [(i, body(i, 60, ["Achk", "achk."]), "de") for i in range(4)] + [(10, body(10, 60, ["achk", "achk"]), "fr")]
    rows += [(20, body(20, 3000, ["achk", "achk"]), "de"), (21, body(21, 60, ["vile", "vile"]), "fr"), (22, body(22, 60), "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in (0, 1, 2, 3, 10, 21, 22)], "doc_id long, toxic int")
    toxic = quality_rules.toxic_terms(table, labels)
    assert toxic == {"de": frozenset(["achk"])}
    got = {r["doc_id"]: r["rejected_by"] for r in quality_rules.apply_rules(table, quality_rules.with_terms(toxic)).collect()}
    assert got == {i: "insults" if i < 4 else None for i, *_ in rows}
    long = spark.createDataFrame([(1, body(1, 3000, ["vile", "vile"])), (2, body(2, 60, ["vile", "vile"]))], DOCS)
    assert {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(long).collect()} == {1: True, 2: False}


def test_substring_dedup(docs, empty, spark):
    assert substring_dedup.dedup_passages(empty).count() == 0
    got = sorted((r["doc_id"] or -1, r["n_removed"], r["text"]) for r in substring_dedup.dedup_passages(docs).collect())
    words = [WORD.findall(t or "") for _, t in TEXTS]
    seen = {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    want = []
    for (i, text), w in zip(TEXTS, words):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        want.append((i or -1, len(gone), " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text or ""))
    assert got == sorted(want)


def test_suffix_dedup(docs, empty):
    assert suffix_dedup.dedup_bytes(empty).count() == 0
    got = sorted((r["doc_id"] or 99, r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(docs).collect())
    rows = [(i or 99, (t or "").encode()) for i, t in TEXTS]
    want = []
    for i, t in rows:
        before = {u[k : k + 50] for j, u in rows if j < i for k in range(len(u) - 49)}
        gone = set()
        for k in range(len(t) - 49):
            if t[k : k + 50] in before:
                gone |= set(range(k, k + 50))
        want.append((i, len(gone), bytes(b for k, b in enumerate(t) if k not in gone)))
    assert got == sorted(want)


def test_suffix_dedup_of_passages_that_many_texts_of_a_shard_share(spark):
    rng = np.random.default_rng(3)
    passages = [" ".join(f"p{x}" for x in rng.integers(0, 40, 30)) for _ in range(12)]
    rows = [(i, " ".join(passages[p][int(rng.integers(0, 20)) :] for p in rng.integers(0, 12, 4))) for i in range(120)]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = []
    for i, t in rows:
        gone = {x for k in range(len(t) - 49) if first[t[k : k + 50]] < i for x in range(k, k + 50)}
        want.append((i, "".join(c for k, c in enumerate(t) if k not in gone)))
    got = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, DOCS)).select("doc_id", F.col("kept").cast("string")).collect()
    assert sorted(map(tuple, got)) == want


def test_packing_of_texts_that_spell_out_special_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|>world", "<|endoftext|>", "a <|endoftext|><|endoftext|> b  c", "<|endoftext |>", "x" * 3000 + "<|endoftext|>"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        own = b"".join(r["ids"] for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(own, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_toxic_terms_of_a_language_are_the_same_beside_a_larger_one(spark):
    small = [(i, f"mild text grumox {i}" if i % 2 else f"mild text here {i}", "de") for i in range(40)]
    large = [(100 + i, " ".join(f"bad{i % 7}x{k}" for k in range(700)), "en") for i in range(70)]
    labels = [(i, 1, i % 2) for i in range(40)] + [(100 + i, 1, 1) for i in range(70)]
    shape = "doc_id long, text string, lang string"
    for rows in (small, small + large):
        found = quality_rules.toxic_terms(spark.createDataFrame(rows, shape), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert found["de"] == {"grumox"}
    assert len(found["en"]) == 4900  # more than any quota in all
    rare = [(i, f"common word{i // 3} text", "en") for i in range(3000)]  # three documents are less than the share
    assert quality_rules.toxic_terms(spark.createDataFrame(rare, shape), spark.createDataFrame([(i, 1, 1) for i in range(3000)], "doc_id long, quality int, toxic int"))["en"] == {"common", "text"}


def test_rules_are_ordered_by_what_is_left_and_what_is_known(spark):
    def slow(t):
        return sum(range(200_000)) < 0

    rules = [quality_rules.Rule("never", slow), quality_rules.Rule("tiny", lambda t: t.n_words < 60), quality_rules.Rule("upper", lambda t: t.n_upper > 300), quality_rules.Rule("same", lambda t: t.n_upper > 200)]
    body = " ".join(f"word{k}" for k in range(80))
    rows = [(i, body if i % 3 else body.upper()) for i in range(90)] + [(100 + i, "short") for i in range(500)]
    order = [r.name for r in quality_rules.order_rules(spark.createDataFrame(rows, "doc_id long, text string"), rules)]
    assert order[0] in ("upper", "same") and order[-1] == "never"  # what fails the base is no reason to begin with "tiny"
    assert quality_rules.order_rules(spark.createDataFrame([], "doc_id long, text string"), rules) == rules


def test_slots_are_the_same_however_the_table_is_split(spark):
    rows = [(None if i % 50 == 0 else i % 700, "t" * (i % 9)) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(repr, sharding.assign_shards(table.repartition(n), 3).collect())) for n in (1, 7)]
    assert found[0] == found[1]
    by_shard = {}
    for r in sharding.assign_shards(table, 3).collect():
        by_shard.setdefault(r["shard"], []).append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    for own in by_shard.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_near_duplicates(docs, empty):
    assert order_minhash.near_duplicates(empty).count() == 0
    got = sorted((r["doc_id"] or -1, r["class_id"]) for r in order_minhash.near_duplicates(docs).collect())
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (7, 7), (-1, 1), (8, 8)])


def test_near_duplicates_with_a_line_repeated(spark):
    rows = []
    for p in range(10):
        head, line = [f"h{p}x{i}" for i in range(200)], [f"l{p}x{i}" for i in range(10)]
        other = [*line[:4], f"o{p}", *line[5:]]
        rows += [(2 * p, head + line * 300), (2 * p + 1, head + other * 300)]

    def near(a, b):
        return sum(v != w for v, w in zip(a, b)) <= 0.2 * len(a)

    want = {i: min(j for j, b in rows if near(a, b)) for i, a in rows}
    assert want == {i: i - i % 2 for i in range(20)}
    got = order_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], DOCS))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == want


def test_near_duplicates_that_lie_within_one_text(spark):
    rng = np.random.default_rng(3)
    whole = [f"w{k}" for k in rng.integers(0, 4000, 900)]
    rows = [whole]
    for at in (np.repeat([0, 120, 240, 360, 480], 8) + rng.integers(0, 16, 40)).tolist():  # parts of the whole, near those of their own kind but not the whole
        rows.append(whole[at : at + 400])
        rows.append(whole[at + 12 : at + 400] + ["other"])
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], DOCS)).collect()}
    words = [order_minhash.hashed_words([" ".join(t).encode()])[0] for t in rows]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if order_minhash.aligned(words[i], words[j], 0.8):
                a, b = sorted((want[i], want[j]))
                want = [a if c == b else c for c in want]
    assert got == dict(enumerate(want))
    assert len(set(want)) == 6


def test_near_duplicates_of_short_texts_are_all_found(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):  # texts of 1 to 11 words, each with up to two words changed, taken out or put in anywhere
        text = [f"w{k}x{i}" for i in range(k % 11 + 1)]
        rows.append(text)
        for _ in range(3):
            other = list(text)
            for _ in range(len(text) // 5):
                at, kind = int(rng.integers(len(other))), int(rng.integers(3 if len(text) < 10 else 2))
                other[at : at + (kind < 2)] = [f"n{rng.integers(10**9)}"] if kind != 1 else []
            rows.append(other)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], DOCS)).collect()}
    assert got == {i: i - i % 4 for i in range(len(rows))}


def test_near_duplicates_with_words_changed_all_over(spark):
    """Every tenth word changed leaves few runs of five words, and no fewer links; texts that share two thirds aren't linked."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(40):
        text = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        for share in (0.0, 0.1, 0.1):
            rows.append([f"c{rng.integers(10**9)}" if rng.random() < share else w for w in text])
        rows.append(text[:133] + [f"o{k}x{i}" for i in range(67)])
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], DOCS)).collect()}
    assert got == {i: i - i % 4 if i % 4 < 3 else i for i in range(len(rows))}


def test_texts_of_a_dense_hub_are_compared_only_if_their_words_let_them_be_near(spark, monkeypatch):
    """A line repeated all over, and own words of a small vocabulary that any three texts share."""
    monkeypatch.setattr(order_minhash, "BLOCK", 16, raising=False)
    rng = np.random.default_rng(14)
    rows = [["is", "one"] * 150 + [f"w{x}" for x in rng.integers(0, 60, rng.integers(2, 140))] for _ in range(90)]
    rows[0] = ["is", "one"] * 150
    words = [order_minhash.hashed_words([" ".join(t).encode()])[0] for t in rows]
    bags = [Counter(t) for t in rows]
    inside = [order_minhash.aligned(words[0], w, 0.8) for w in words]
    star = [(0, k, len(rows[k]), (bags[0] & bags[k]).total(), inside[k], 0 if inside[k] else k) for k in range(1, 90)]
    star = spark.createDataFrame(star, "hub long, x long, n long, common long, inside boolean, class long")
    texts = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], "node long, text string")
    got = {tuple(sorted(r)) for r in order_minhash.beyond_hub(star, texts, 0.8, 1).collect()}
    want = {(a, b) for b in range(1, 90) for a in range(1, b) if not (inside[a] and inside[b]) and (bags[a] & bags[b]).total() >= 0.8 * max(len(rows[a]), len(rows[b])) - 1e-6}
    assert got == want and 20 < len(want) < 3000 and 10 < sum(inside) < 80


def test_sharding(docs, empty):
    assert sharding.assign_shards(empty).count() == 0
    rows = sharding.assign_shards(docs, 4).collect()
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (5, 6)} == {16}
    keys = np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert ((a == b) | (b == 40)).all() and 150 < (a != b).sum() < 350 and np.bincount(a).min() > 150


def test_bpe(docs):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs.where("doc_id = 8 OR doc_id IS NULL"), path, P.PATTERN).collect():
        text = TEXTS[-1][1] if r["doc_id"] == 8 else BODY
        assert np.frombuffer(r["ids"], "<u4").tolist() == e.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


def test_fingerprints(docs, empty):
    assert fingerprints.fingerprint_pairs(empty).count() == 0
    rows = fingerprints.fingerprint_pairs(docs).collect()
    assert len(rows) == len(TEXTS)
    own = {r["doc_id"]: r for r in rows}
    assert own[1]["fingerprint"] == own[2]["fingerprint"] and own[2]["near_next"] == 1.0
    assert own[4]["edited_text"] == NEAR[: len(NEAR) - len(NEAR) // 2] + TEXTS[2][1][: len(NEAR) // 2]
    assert own[1]["n_chars"] == len(BODY)


def test_lattice_and_scores(docs, empty):
    p = {b"a": 0.2, b"b": 0.1, b"ab": 0.3, b"aba": 0.05, b"c": 0.05}

    def brute(w):
        return 1.0 if not w else sum(p[w[:k]] * brute(w[k:]) for k in range(1, min(3, len(w)) + 1) if w[:k] in p)

    lattice, words = Lattice(list(p), np.log([*p.values(), 0.3])), [b"abab", b"a", b"abaabc", b"cab"]
    assert np.allclose(np.exp(lattice.forward(words)), [brute(w) * 0.3 for w in words])
    path = P.path("piece_bpe_32k.model")
    rows = score_texts(docs, F.coalesce(F.col("doc_id") != 3, F.lit(True)), path).collect()
    train = [t for i, t in TEXTS if i != 3]
    n = sum(len(WORD.findall(t or "")) + 1 for t in train)
    assert len(rows) == len(TEXTS) and {r["train_tokens"] for r in rows} == {n} and all(r["score"] < 0 for r in rows)
    assert next(r["n_known"] for r in rows if r["doc_id"] == 3) == 61
    assert score_texts(empty, F.lit(True), path).count() == 0




def thue_morse(n, a, b):
    return "".join(a if bin(k).count("1") % 2 else b for k in range(n))


def test_texts_that_linear_hashes_confuse(spark):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    texts = [thue_morse(n, *ab) for n in (1024, 4096) for ab in ("ab", "ba")]
    rows = [(i, texts[i % 4]) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs, path, P.PATTERN).collect():
        text = rows[r["doc_id"]][1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == e.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    t, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}
    for r in packing.pack(docs, P.path("byte_bpe_50k.json")).collect():
        own.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, text in rows:
        assert sum((ids for _, ids in sorted(own[i])), []) == [*t.encode(text, add_special_tokens=False).ids, 1]
    rest = [f"w{k}" for k in range(34)]
    two = spark.createDataFrame([(k, " ".join([texts[k], *rest])) for k in (0, 1)], DOCS)
    assert [r["n_removed"] for r in substring_dedup.dedup_passages(two).collect()] == [0, 0]


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    from listingflow.llm import units

    texts = ["one more time", "two more times and longerwordsthaneight", "", "one  run", "longerwordsthaneighT\nmore"] * 3
    want = [[ord(c) for c in t] for t in texts]
    plain = units.UnitEncoder(lambda part: list(map(ord, part)))
    for encoder in (plain, plain):
        assert [x.tolist() for x in encoder(texts)] == want
    monkeypatch.setattr(units, "span_hashes", lambda data, start, size: size.astype(np.uint64) % np.uint64(3))
    assert [x.tolist() for x in units.UnitEncoder(lambda part: list(map(ord, part)))(texts)] == want


def test_edit_distance_equals_the_table_method():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(4)
    cases = [([ord(c) for c in thue_morse(128, "a", "b")], [ord(c) for c in thue_morse(128, "b", "a")]), ([], []), ([1], []), ([1] * 300, [1] * 290)]
    for _ in range(30):
        a = rng.integers(0, 50, int(rng.integers(1, 150))).tolist()
        b = [x for x in a if rng.random() > 0.05]
        b[len(b) // 2 : len(b) // 2] = rng.integers(0, 50, int(rng.integers(0, 6))).tolist()
        cases.append((a, b))
    for a, b in cases:
        want = edits(a, b)
        for most in (want, want + 3, max(want - 1, 0)):
            assert order_minhash.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(want, most + 1)


def passages_removed(rows, length=35):
    words = [t.split() for _, t in rows]
    seen = {}
    for w in words:
        for k in range(len(w) - length + 1):
            seen[tuple(w[k : k + length])] = seen.get(tuple(w[k : k + length]), 0) + 1
    out = []
    for (i, _), w in zip(rows, words):
        gone = {x for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for x in range(k, k + length)}
        out.append((i, len(gone)))
    return sorted(out)


def bytes_removed(rows, length=50):
    first, out = {}, []
    for i, t in sorted(rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    for i, t in rows:
        out.append((i, len({x for k in range(len(t) - length + 1) if first[t[k : k + length]] < i for x in range(k, k + length)})))
    return sorted(out)


def test_heavy_anchors_and_very_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    phrase, passage = [f"common{k}" for k in range(20)], [f"shared{k}" for k in range(45)]

    def own(n):
        return [f"x{v}" for v in rng.integers(0, 5000, n)]

    rows = [(i, " ".join(own(20) + phrase + own(20) + (passage if i % 2 else []) + own(15))) for i in range(40)]
    long = own(20_000)
    rows += [(90, " ".join(long + passage + long[500:900])), (91, " ".join(long[3000:3100])), (92, " ".join(phrase * 300))]
    docs, words, letters = spark.createDataFrame(rows, DOCS), passages_removed(rows), bytes_removed(rows)
    for heavy in (512, 2):
        monkeypatch.setattr(anchors, "HEAVY", heavy)
        assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_passages(docs, shard_bytes=1 << 15).collect()) == words
        assert sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup_bytes(docs, shard_bytes=1 << 15).collect()) == letters
    monkeypatch.setattr(substring_dedup, "AUTOMATON_WORDS", 50)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_passages(docs).collect()) == words
    monkeypatch.setattr(substring_dedup, "occurrences", lambda passages, texts: [np.zeros(len(t.split()), bool) for t in texts])
    assert {r["n_removed"] for r in substring_dedup.dedup_passages(docs).collect()} == {0}  # what the automata find is all that goes


def test_runs_of_pieces_are_those_of_the_whole():
    values = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint64)

    def windows(block):
        return sorted((f + k, f + b, key) for r in anchors.runs_of([values, values[:40], values[:3]], 35, 8, block) for f, n, b, key in zip(r.first.tolist(), r.count.tolist(), r.before.tolist(), r.key.tolist()) for k in range(n))

    assert windows(100) == windows(1 << 20) and len(windows(100)) == 4966 + 6


def test_fingerprints_by_join_are_those_by_broadcast(docs, empty, spark):
    rows = [(i % 7 if i % 3 else None, f"same words {i % 11} and others {i}" * (i % 4)) for i in range(200)]
    for table in (docs, empty, spark.createDataFrame(rows, DOCS)):
        one, two = (sorted(map(repr, fingerprints.fingerprint_pairs(table, most_sent=n).collect())) for n in (1 << 20, -1))
        assert one == two and len(one) == table.count()


def test_network_scores_whole_texts_as_loops_do():
    rng = np.random.default_rng(2)
    net = Network(rng.normal(size=(256, 8)), rng.normal(size=(WIDTH, 8, FILTERS)), rng.normal(size=FILTERS), rng.normal(size=2 * FILTERS) / 9, 0.1)
    texts = [b"", b"a", rng.integers(32, 120, SEGMENT * 3 + 5, np.uint8).tobytes(), rng.integers(0, 256, 1000, np.uint8).tobytes() * 3]
    for text, got in zip(texts, net.scores(texts)):
        n = max(1, -(-len(text) // SEGMENT))
        data = net.embedding[np.frombuffer(text.ljust(n * SEGMENT + WIDTH, b"\0"), np.uint8)]
        at = np.array([sum(data[p + k] @ net.kernel[k] for k in range(WIDTH)) for p in range(n * SEGMENT)]).reshape(n, SEGMENT, FILTERS).max(axis=1)
        chunks = np.maximum(np.array([np.maximum(at[k], at[min(k + 1, n - 1)]) for k in range(max(1, n - 1))]) + net.bias, 0)
        want = 1 / (1 + np.exp(-(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.head + net.prior)))
        assert abs(got - want) < 1e-4


def test_odd_rows_of_row_by_row_operators(docs, empty, spark):
    """Null ids, null and empty texts, repeated rows, a very long text and columns of clashing names."""
    long = " ".join(f"word{k % 977} é" for k in range(30_000))
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(11, long), (11, long)], DOCS)).withColumns({"score": F.lit("x"), "ids": F.lit(1), "n_words": F.lit(0), "lang": F.lit(None).cast("string"), "kept": F.lit(5)})
    texts = [t or "" for _, t in TEXTS] + [long, long]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    decoded = sorted(bytes(r["decoded"]).decode() for r in bpe.encode_decode(table, path, P.PATTERN).collect())
    assert decoded == sorted(texts) and bpe.encode_decode(empty, path, P.PATTERN).count() == 0
    ruled = quality_rules.apply_rules(table).collect()
    assert sorted(r["n_words"] for r in ruled) == sorted(len(WORD.findall(t)) for t in texts)
    assert [r["kept"] for r in ruled if r["doc_id"] == 11] == [True] * 2 or [r["kept"] for r in ruled if r["doc_id"] == 11] == [False] * 2
    assert sum(r["doc_id"] is None for r in ruled) == 1
    labels = spark.createDataFrame([(1, 1), (3, 1), (7, 0), (6, 0), (None, 1)], "doc_id long, quality int")
    scored = score_quality(table, labels, F.lit(True)).collect()
    assert len(scored) == len(texts) and len({r["score"] for r in scored if r["doc_id"] == 11}) == 1 and len({r["score"] for r in scored if r["doc_id"] in (5, 6)}) == 1
    packed = packing.pack(table, P.path("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 11) == 2 * next(r["doc_tokens"] for r in packed if r["doc_id"] == 11)
    lines = score_texts(table, F.lit(True), P.path("piece_bpe_32k.model")).collect()
    assert sorted(r["n_tokens"] for r in lines) == sorted(len(WORD.findall(t)) + 1 for t in texts)
    assert sorted(r["size"] for r in sharding.assign_shards(table, 3).collect()) == sorted(len(t.encode()) + 16 for t in texts)
