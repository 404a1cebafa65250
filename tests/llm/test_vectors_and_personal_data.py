"""The operators on vectors and on personal data against brute force, on odd rows and on whole tables."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listingflow.llm import queries
from listingflow.llm.centroid_clusters import Base, cluster_vectors, nearest, squared
from listingflow.llm.personal_data import find_personal_data, listed, redacted, running_sums
from listingflow.llm.vector_codes import Blocks, encode_vectors, hilbert_order, with_label_errors
from listingflow.llm.vectors import floored

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    turned = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in turned) % 10 == 0


def base_spans(text):
    """Spans of the plain patterns in the order of start and kind."""
    valid = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return sorted(((m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if valid[kind](m[0])))


def told(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def found(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in redacted(find_personal_data(docs)).select("*", listed(F.col("personal")).alias("spans"), listed(F.filter("personal", lambda s: s["base"])).alias("base")).collect()}


def test_op11_base_equals_python_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r["spans"] for r in rows)
    for r in rows:
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(told(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[2] == k for s in spans) for k in PLAIN]
        assert set(told(spans).split(",")) - {""} <= set(r["spans"].split(","))


def test_base_spans_of_odd_texts(spark):
    texts = [
        "", "a@b", "a@b.c", "é a.b@c-d.e._x@y.z@w.v 😀 q@r.s", "1.2.3.4.5.6.7.8", "0001.255.256.1 01.02.03.0004", "x1.2.3.4y", "+1 (826) 555-4081 190.137.223.204",
        "4111 1111 1111 1111", "4111-1111 1111-1112", "0 " * 40, "00 00 00 00 00 00", "+1 23.4-(5) 6789 x +12 3", "@@..++", "9" * 5000 + " " + "a." * 5000 + "@b.c" + ".d" * 5000,
        "mail a@b.co " * 700, "+" * 3000 + "1" * 13, "12-" * 3000, "a" * 20000 + " @", "1." * 20000,
    ]
    rows = found(spark, *texts)
    for i, text in enumerate(texts):
        assert rows[i]["base"] == told(base_spans(text)), text[:50]


def test_added_spans_need_checksums_or_context(spark):
    rows = found(
        spark, "pay to DE89 3704 0044 0532 0130 00 now", "pay to DE88 3704 0044 0532 0130 00 now", "my SSN: 123-45-6789", "part 123-45-6789", "ssn 666-45-6789", "please call 212-555-1234 or xyz",
        "order 212-555-1234", "7 4111 1111 1111 1111 +1 (826) 555-4081 190.137.223.204", "phone +1 826 555 4081", None,
    )
    assert [rows[i]["spans"] for i in range(7)] == ["iban:7:34", "", "ssn:8:19", "", "", "phone:12:24", ""]
    assert rows[7]["spans"] == "card:2:21,phone:22:39,ip:40:55" and rows[7]["base"] == "ip:40:55"
    assert rows[8]["spans"] == rows[8]["base"] == "phone:6:21"
    assert rows[2]["text"] == "my SSN: <ssn>" and rows[0]["text"] == "pay to <iban> now" and rows[9]["text"] is None and rows[9]["spans"] == ""
    assert {s["kind"]: s["score"] for s in rows[7]["personal"]} == {"card": 0.8, "phone": 0.6, "ip": 0.6} and rows[8]["personal"][0]["score"] == 1.0


def test_personal_data_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.co", "x"), (1, "a@b.co", None), (1, "a@b.co", "x"), (2, None, "y")], "doc_id long, text string, personal string")
    rows = find_personal_data(docs, carry=["personal"]).collect()
    assert len(rows) == 4 and sorted(len(r[-1]) for r in rows) == [0, 1, 1, 1]
    assert find_personal_data(docs.limit(0)).count() == 0
    plan = find_personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_running_sums_over_blocks(spark):
    for n in (0, 1, 256, 257, 700):
        got = spark.range(1).select(running_sums(F.array(*(F.lit(i).cast("long") for i in range(n))).cast("array<bigint>"))).first()[0]
        assert got == [i * (i - 1) // 2 for i in range(n)]


def means(sums, counts, old):
    return [[s // c for s in row] if c else before for row, c, before in zip(sums, counts, old)]


def k_means(vectors, centroids, rounds):
    """Python integers all through: centroids, assignment and distances."""
    centroids = [list(c) for c in centroids]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for v in vectors]

    for _ in range(rounds):
        sums, counts = [[0] * len(c) for c in centroids], [0] * len(centroids)
        for v, (_, j) in zip(vectors, assign()):
            counts[j] += 1
            sums[j] = [a + b for a, b in zip(sums[j], v)]
        centroids = means(sums, counts, centroids)
    return centroids, assign()


ODD = [
    (5, [0.5, -0.25, 3.0, 1.0], "a"), (5, [0.5, -0.25, 3.0, 1.0], "a"), (1, [1e4, -1e4, 0.0, 7.0], None), (2, [-0.001, 0.0, 0.0, -1.0], None), (None, [2.0, 2.0, 2.0, 2.0], "b"),
    (7, None, "a"), (8, [1.0, None, 1.0, 1.0], "a"), (9, [1.0, float("nan"), 1.0, 1.0], "a"), (10, [1.0, float("inf"), 1.0, 1.0], "b"), (11, [], "c"), (12, [1.0, 2.0], "c"), (3, [0.1, 0.2, 0.3, 0.4], "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ODD], "vec_id long, embedding array<float>, label string, cluster string").repartition(3)


def ints(vector, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in vector]


def test_clusters_of_odd_rows(odd):
    kept = [(i, ints(v, 1024)) for i, v, _ in ODD if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"3:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    for k, pivots in ((1, 1), (3, 2), (4, 5), (50, 5)):
        centroids, best = k_means([v for _, v in kept], [kept[r][1] for r in order[:k]], 4)
        rows = cluster_vectors(odd, k=k, rounds=4, dimension=4, pivots=pivots).collect()
        total = sum(d for d, _ in best)
        want = [(i, j, d, sum(x for x, y in best if y == j), total, centroids[j]) for (i, _), (d, j) in zip(kept, best)]
        assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))
    assert cluster_vectors(odd.limit(0), dimension=4).count() == 0 and cluster_vectors(odd, dimension=3).count() == 0


def test_codes_of_odd_rows(odd):
    kept = [(i, lab, v) for i, v, lab in ODD if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    same = sorted(((i, lab, ints(v, 256)) for i, lab, v in kept if len(v) == 4), key=lambda r: (r[0] is None, r[0], r[2]))
    for entries in (1, 3, 64):
        books, best = zip(*(k_means([v[2 * p : 2 * p + 2] for *_, v in same], [v[2 * p : 2 * p + 2] for *_, v in same[:entries]], 2) for p in range(2)))
        errors = [a[0] + b[0] for a, b in zip(*best)]
        want = [(i, lab, bytes((a[1], b[1])), e, sum(x for x, (_, other, _) in zip(errors, same) if other == lab)) for (i, lab, _), a, b, e in zip(same, *best, errors)]
        want += [(11, "c", None, None, None), (12, "c", None, None, None)]
        coded, found_books = encode_vectors(odd, parts=2, entries=entries)
        rows = [(r["id"], r["label"], r["code"] and bytes(r["code"]), r["error"], r["label_error"]) for r in with_label_errors(coded).collect()]
        assert found_books.tolist() == [list(map(list, b)) for b in books]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
    assert encode_vectors(odd.limit(0), parts=2)[0].count() == 0
    assert {r["code"] for r in encode_vectors(odd, parts=3)[0].collect()} == {None}
    with pytest.raises(ValueError):
        encode_vectors(odd, entries=257)


def test_curve_goes_to_neighbours():
    for width, side in ((1, 9), (2, 16), (3, 8), (4, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(side)] * width, indexing="ij"), -1).reshape(-1, width)
        order = hilbert_order(grid)
        assert sorted(order) == list(range(len(grid)))
        assert np.abs(np.diff(grid[order], axis=0)).sum(1).max() == 1 or side == 9
    assert len(hilbert_order(np.zeros((5, 40), np.int64))) == 5 and len(hilbert_order(np.zeros((0, 4), np.int64))) == 0


def test_blocks_find_the_nearest_and_skip_most():
    rng = np.random.default_rng(1)
    for n, spread, width in ((1, 9, 4), (17, 3, 2), (3000, 100, 4), (3000, 4, 3), (500, 10**6, 1)):
        points, entries = rng.integers(-spread, spread, (n, width)), rng.integers(-spread, spread, (40, width))
        blocks = Blocks.of(points[hilbert_order(points)])
        best, distance, alone = blocks.assign(entries, exact=True)
        table = squared(blocks.members, entries)
        assert (best == table.argmin(1)).all() and (distance == table.min(1)).all()
        assert blocks.sums.sum(0).tolist() == points.sum(0).tolist()
    near = np.repeat(np.eye(4, dtype=np.int64) * 1000, 64, 0) + rng.integers(0, 9, (256, 4))
    assert Blocks.of(near[hilbert_order(near)]).assign(np.eye(4, dtype=np.int64) * 1000, exact=False)[2].all()


def test_simplex_bounds_keep_the_nearest():
    rng = np.random.default_rng(2)
    tables = [rng.integers(-500, 500, (400, 12)), np.repeat(rng.integers(-9, 9, (4, 12)), 100, 0), rng.integers(-2, 3, (400, 12)) + 10**6 * rng.integers(0, 2, (400, 1)), np.zeros((400, 12), np.int64)]
    tables.append(np.concatenate([rng.integers(0, 2, (200, 12)), rng.integers(-(10**8), 10**8, (200, 12))]))
    for vectors in tables:
        for pivots in (1, 2, 5, 13):
            base, centroids = Base.of(vectors[:40], pivots), np.concatenate([vectors[::60], vectors[:3] + 1])
            best, distance, compared = nearest(vectors, squared(vectors, base.pivots), base, centroids)
            table = squared(vectors, centroids)
            assert (best == table.argmin(1)).all() and (distance == table.min(1)).all() and len(vectors) <= compared <= table.size
    base = Base.of(tables[0][:40], 13)
    assert nearest(tables[0], squared(tables[0], base.pivots), base, tables[0][:8])[2] == 400


def test_components_without_a_distance_in_64_bits_raise():
    with pytest.raises(ValueError):
        floored(pa.array([[1e30, 0.0]]), 2, 1024)
