"""Near-duplicate classes by order min-hash sketches and banded alignment."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from .common import checkpointed, in_chunks, spread, texts_of
from .hashing import mix, window_hashes
from .wording import hashed_words

#: Samples of a sketch, and occurrence-labelled shingles of so many words in each, in the order of the text. Of two texts
#: with every tenth word edited at random about 57 of 100 shingles are common, and of every fifth word 34: three least ones
#: are then the same in 0.19 and 0.041 of the samples, and 48 samples all miss with 7e-5 and 0.13.
SAMPLES, EACH, SHINGLE = 48, 3, 3
#: Texts of so many words at most, and edits between them, are found by what is left when words are taken out, without fail.
SHORT, SHORT_EDITS = 11, 2
_SEEDS = np.random.default_rng(13).integers(0, 2**63, SAMPLES).astype(np.uint64)
#: Runs that a hub lacks of which two texts must share so many, if they need that many, before they are compared.
FEW = 3
#: Texts of a hub that are held against so many others at a time, where the hub's texts share too many runs to go by them.
BLOCK = 128
#: Rows that a join by runs may make for each row that blocks would take, before the hub goes by blocks.
DENSE = 8
#: Keeps rounding from tightening a bound.
_SLACK = 1e-6


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words in order; a shorter text is one shingle, a text without words one of its own kind."""
    if len(words) < k:
        return np.bitwise_xor.reduce(mix(words + np.arange(1, len(words) + 1, dtype=np.uint64)), keepdims=True) ^ np.uint64(len(words) + 1)
    return window_hashes(words, k)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles told apart by how many equal ones come before them."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    if len(new) == len(s):
        return s
    nth = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    out = np.empty_like(s)
    out[order] = np.where(nth > 0, mix(t + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), t)
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """For each sample, a hash of its EACH least labelled shingles in the order of the text."""
    plain = shingles(words)
    s = labelled(plain)
    n = min(EACH, len(s))
    out = np.empty(SAMPLES, np.uint64)
    step = max(1, (1 << 20) // len(s))
    for at in range(0, SAMPLES, step):
        h = mix(s[None, :] ^ _SEEDS[at : at + step, None])
        place = np.sort(np.argpartition(h, n - 1, axis=1)[:, :n] if n < len(s) else np.broadcast_to(np.arange(n), (len(h), n)), axis=1)
        total = _SEEDS[at : at + step].copy()
        for k in range(n):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + plain[place[:, k]])
        out[at : at + step] = total
    return out


def shortened(words: np.ndarray) -> np.ndarray:
    """Hashes of a short text with up to SHORT_EDITS words taken out; texts within that many edits have one in common."""
    if not 0 < len(words) <= SHORT:
        return np.zeros(0, np.uint64)
    kept = [k for d in range(SHORT_EDITS + 1) for k in combinations(range(len(words)), max(len(words) - d, 0))]
    out = [np.bitwise_xor.reduce(mix(words[list(k)] + np.arange(1, len(k) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) ^ np.uint64(len(k)) for k in kept if k]
    return np.unique(np.array(out, np.uint64))


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """The labelled runs of q words as a sorted set."""
    return np.sort(labelled(words if q == 1 else shingles(words, q)))


def needed(n: Column | np.ndarray, q: int, least: float) -> Column | np.ndarray:
    """Labelled runs of q words that a text of n words has in common with any text that it is near: an edit spoils q at most."""
    return (1 - q * (1 - least)) * n - (q - 1)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts begin with together."""
    at, step = 0, 64
    while at < min(len(a), len(b)):
        n = min(step, len(a) - at, len(b) - at)
        other = np.flatnonzero(a[at : at + n] != b[at : at + n])
        if len(other):
            return at + int(other[0])
        at, step = at + n, step * 4
    return at


def _extended(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far the words of a from i and of b from j on agree."""
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    for _ in range(6):
        live = live[(i[live] + out[live] < len(a)) & (j[live] + out[live] < len(b))]
        live = live[a[i[live] + out[live]] == b[j[live] + out[live]]]
        if not len(live):
            return out
        out[live] += 1
    for k in live.tolist():
        out[k] += _common(a[i[k] + out[k] :], b[j[k] + out[k] :])
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edits from a to b, or most + 1 if there are more.

    The alignment keeps to a band of diagonals that widens by one with each edit; on each diagonal it
    runs along the words that agree.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    reach = np.full(2 * most + 3, -2, np.int64)  # furthest place in a on each diagonal i - j, shifted by most + 1
    for d in range(most + 1):
        k = np.arange(-d, d + 1)
        at = k + most + 1
        if d == 0:
            i = np.zeros(1, np.int64)
        else:
            i = np.maximum(np.maximum(reach[at] + 1, reach[at - 1] + 1), reach[at + 1])
        i = np.minimum(i, np.minimum(n, m + k))
        ok = (i >= 0) & (i - k >= 0) & (k <= n) & (-k <= m)
        i = np.where(ok, i, -2)
        live = np.flatnonzero(ok)
        i[live] += _extended(a, b, i[live], i[live] - k[live])
        reach[at] = i
        if abs(n - m) <= d and reach[n - m + most + 1] >= n:
            return d
    return most + 1


def common_shingles(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted sets."""
    return len(x) + len(y) - len(np.unique(np.concatenate([x, y])))


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether an alignment finds this edit similarity between two texts' words."""
    most = int((1 - least) * max(len(a), len(b), 1) + _SLACK)
    return edit_distance(a, b, most) <= most


def _digest(text: str) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, samples); digest names the text, n counts its words; what follows the samples are hashes of the shortened text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, size=1 << 20):
            each = hashed_words([t.encode() for t in texts_of(batch)])
            found = [np.concatenate([sketch(x), shortened(x)]) for x in each]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            samples = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
            sizes = pa.array([len(x) for x in each], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, samples], names=["doc_id", "digest", "n", "samples"])

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest binary, n long, samples array<long>")


class _Known:
    """Words and runs of words of the texts last seen; pairs come grouped by one of their texts."""

    def __init__(self, *qs: int, most: int = 64):
        self.qs, self.most, self.kept = qs, most, OrderedDict()

    def __call__(self, node: int, text: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        if (found := self.kept.get(node)) is None:
            words = hashed_words([text])[0]
            found = self.kept[node] = words, [grams(words, q) for q in self.qs]
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return found

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple]]]:
        """Slices of rows (a, b, ta, tb) with the words and runs of both texts of each pair."""
        for batch in in_chunks(batches, "ta", "tb"):
            a, b, ta, tb = (batch.column(k) for k in range(4))
            rows = zip(a.to_pylist(), b.to_pylist(), ta.cast(pa.binary()), tb.cast(pa.binary()))
            yield batch, ((*self(x, tx.as_py()), *self(y, ty.as_py())) for x, y, tx, ty in rows)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ta, tb) of pairs (a, b), with the texts (node, text) of both.

    `a` may be in very many pairs: its text is joined last, where a skewed join is split, and so is not sent with each.
    """
    y = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    x = y.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return x.select("a", "b", "ta", "tb")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, common, link): how many labelled words and pairs of words both texts have, and whether an alignment finds them near.

    Texts with fewer pairs of words in common than a near text must have aren't aligned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pairs_ in _Known(1, 2).pairs(batches):
            common, link = [], []
            for wa, (a1, a2), wb, (b1, b2) in pairs_:
                ones, twos, n = common_shingles(a1, b1), common_shingles(a2, b2), max(len(wa), len(wb))
                common.append([ones, twos])
                fit = ones >= least * n - _SLACK and (n < 3 or twos >= (1 - 2 * (1 - least)) * n - 1 - _SLACK)
                link.append(bool(fit and aligned(wa, wb, least)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.list_(pa.int64())), pa.array(link, pa.bool_())], names=["a", "b", "common", "link"])

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long, common array<long>, link boolean")


def added_runs(pairs: DataFrame, texts: DataFrame, q: int) -> DataFrame:
    """(a, b, runs): the labelled runs of q words of b's text that a's lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pairs_ in _Known(q).pairs(batches):
            extra = [np.setdiff1d(y, x, assume_unique=True).view(np.int64) for _, (x,), _, (y,) in pairs_]
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, extra)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *extra])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs], names=["a", "b", "runs"])

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long, runs array<long>")


def own_runs(nodes: DataFrame, texts: DataFrame, q: int) -> DataFrame:
    """(x, shingle): the labelled runs of q words of the text of each node x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, size=1 << 20):
            each = [grams(w, q) for w in hashed_words([t.encode() for t in texts_of(batch)])]
            x = np.repeat(batch.column(0).to_numpy(), [len(e) for e in each])
            yield pa.RecordBatch.from_pydict({"x": x, "shingle": np.concatenate(each).view(np.int64)})

    rows = nodes.select("x").join(texts.select(F.col("node").alias("x"), "text"), "x").select("x", "text")
    return rows.mapInArrow(run, "x long, shingle long")


def within_hub(star: DataFrame, texts: DataFrame, least: float, q: int) -> DataFrame:
    """Pairs (a, b) that may be near, of texts that each have as many runs in common with a hub's text as with a near text.

    Of these only texts outside a hub's class matter, and those of its class whose size lets them be near
    one outside. A near pair shares one among all but the needed() - 1 most frequent runs of both, and after the
    first that they share both have enough left for the rest.
    """
    lie = star.where(F.col("common") >= needed(F.col("n"), q, least) - _SLACK)
    sizes = lie.where("NOT inside").groupBy("hub").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    lie = lie.join(sizes, "hub").where((F.col("n") >= least * F.col("low") - _SLACK) & (least * F.col("n") <= F.col("high") + _SLACK))
    nodes = checkpointed(lie.groupBy("x").agg(F.first("n").alias("n"), F.first("class").alias("class"), F.min("inside").alias("inside")))
    each = checkpointed(own_runs(nodes, texts, q))
    counted = each.join(each.groupBy("shingle").agg(F.count("*").alias("often")), "shingle")
    own = Window.partitionBy("x")
    ranked = counted.withColumn("rank", F.row_number().over(own.orderBy("often", "shingle"))).withColumn("size", F.count("*").over(own))
    prefix = ranked.join(nodes, "x").where((F.col("rank") <= F.col("size") - F.ceil(needed(F.col("n"), q, least) - _SLACK) + 1) & (F.col("often") > 1))
    prefix = checkpointed(prefix.select("x", "shingle", "rank", "size", "n", "class", "inside"))
    other = prefix.select("shingle", *(F.col(c).alias(f"y_{c}") for c in ("x", "rank", "size", "n", "class", "inside")))
    left = F.least(F.col("size") - F.col("rank"), F.col("y_size") - F.col("y_rank")) + 1
    longer, shorter = F.greatest("n", "y_n"), F.least("n", "y_n")
    near = (left >= needed(longer, q, least) - _SLACK) & (shorter >= least * longer - _SLACK)
    differ = (F.col("x") < F.col("y_x")) & (F.col("class") != F.col("y_class")) & ~(F.col("inside") & F.col("y_inside"))
    return prefix.join(other, "shingle").where(differ & near).select(F.col("x").alias("a"), F.col("y_x").alias("b"))


def in_blocks(members: DataFrame, least: float, q: int) -> DataFrame:
    """Pairs (a, b) of a hub's texts, one of them not in its class, that share as many runs that the hub lacks as a near pair must.

    `members` has hub, x, n, common, inside, class and runs, those that the hub lacks, and by hub blocks and open_blocks. Each block of open texts meets each block of all in a group of its own, in which the runs in common are counted.
    """
    place = F.xxhash64("x")
    columns = ["hub", "i", "j", "x", "n", "common", "inside", "class", "runs"]

    def dealt(some: DataFrame, own: str, other: str, count: str, others: str) -> DataFrame:
        some = some.withColumn(own, F.pmod(place, F.col(count)))
        return some.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).select(*(F.col(c).alias(c) for c in columns))

    open_ = dealt(members.where("NOT inside"), "i", "j", "open_blocks", "blocks")
    all_ = dealt(members, "j", "i", "blocks", "open_blocks")

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            (x, n, c, _, k), (y, m, d, inside, l) = ([t[name].to_numpy() for name in columns[3:8]] for t in (left, right))
            mine, theirs = (t["runs"].combine_chunks() for t in (left, right))
            values = np.concatenate([mine.flatten().to_numpy(), theirs.flatten().to_numpy()])
            kinds, code = np.unique(values, return_inverse=True)
            ends = np.cumsum(mine.value_lengths().to_numpy())
            own, other = code[: ends[-1]], code[ends[-1] :]
            owner = np.repeat(np.arange(len(y)), theirs.value_lengths().to_numpy())
            has = np.zeros(len(kinds), bool)
            for r, (at, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                has[own[at:end]] = True
                shared = np.bincount(owner[has[other]], minlength=len(y))
                has[own[at:end]] = False
                longer = np.maximum(n[r], m)
                lacking = needed(longer, q, least) - np.minimum(c[r], d)  # none: within_hub() has the pair
                near = (lacking > _SLACK) & (shared >= lacking - _SLACK) & (np.minimum(n[r], m) >= least * longer - _SLACK)
                found = y[near & (l != k[r]) & (inside | (x[r] < y))]
                a.append(np.minimum(x[r], found))
                b.append(np.maximum(x[r], found))
        return pa.table({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})

    keys = ["hub", "i", "j"]
    return open_.groupBy(*keys).cogroup(all_.groupBy(*keys)).applyInArrow(held, "a long, b long")


def beyond_hub(star: DataFrame, texts: DataFrame, least: float, q: int) -> DataFrame:
    """Pairs (a, b) that may be near though one of them is not in its hub's class, without holding all
    such pairs against each other.

    `star` has hub, x, n (words of x), common (labelled runs of q words, with the hub), inside (x is in the hub's class) and
    class. Near texts x and y have s = needed() runs in common. Of these at most min(common_x, common_y) lie in the hub's
    text. So x and y either satisfy s <= min(common_x, common_y), and so lie within the hub's text as within_hub() says, or
    share k = s - min(common_x, common_y) runs that the hub lacks, or more. Of these FEW (or k, if that is less) are among all
    but each text's k - FEW most frequent ones, a prefix filter by rarity among the hub's members; and from the
    first of these on, both have enough left for the rest.
    """
    open_ = star.where("NOT inside").select("hub").distinct()
    here = checkpointed(star.join(open_, "hub"))
    differ = (F.col("class") != F.col("yk")) & ~F.col("inside") & (F.col("yi") | (F.col("x") < F.col("y"))) & (F.least("n", "yn") >= least * F.greatest("n", "yn") - _SLACK)

    extra = added_runs(here.select(F.col("hub").alias("a"), F.col("x").alias("b")), texts, q).select(F.col("a").alias("hub"), F.col("b").alias("x"), "runs")
    extra = checkpointed(extra.repartition("hub", "x"))  # the texts of one hub apart
    counted = extra.select("hub", "x", F.explode("runs").alias("shingle")).withColumn("often", F.count("*").over(Window.partitionBy("hub", "shingle"))).where("often > 1")
    # runs of no other member stand before the others in the order of rarity, so places are counted from the end
    frequent = Window.partitionBy("hub", "x").orderBy(F.desc("often"), F.desc("shingle"))
    ranked = counted.withColumn("behind", F.row_number().over(frequent)).join(here, ["hub", "x"])
    need = F.greatest(F.ceil(needed(F.col("n"), q, least) - F.col("common") - _SLACK), F.lit(1))
    ranked = ranked.withColumn("few", F.least(need, F.lit(FEW))).where(F.col("behind") > need - F.col("few"))
    prefix = checkpointed(ranked.select("hub", "x", "shingle", "behind", "few", "n", "common", "inside", "class"))
    meets = prefix.groupBy("hub", "shingle").agg((F.count("*") * F.count_if(~F.col("inside"))).alias("meets")).groupBy("hub").agg(F.sum("meets").alias("meets"))
    sizes = here.groupBy("hub").agg(F.count("*").alias("size"), F.count_if(~F.col("inside")).alias("open"))
    sizes = sizes.select("hub", "size", "open", F.ceil(F.col("size") / BLOCK).alias("blocks"), F.ceil(F.col("open") / BLOCK).alias("open_blocks"))
    dense = sizes.join(meets, "hub").where(F.col("meets") > DENSE * (F.col("open") * F.col("blocks") + F.col("size") * F.col("open_blocks")))
    dense = checkpointed(dense.select("hub", "blocks", "open_blocks"))
    by_block = in_blocks(checkpointed(here.join(dense, "hub").join(extra, ["hub", "x"])), least, q)
    sparse = here.where("NOT inside").join(dense, "hub", "left_anti").select("hub", "x")
    other = prefix.select(F.col("hub").alias("g"), F.col("shingle").alias("z"), *(F.col(c).alias(f"y{c[0]}") for c in ("behind", "few", "n", "common", "inside")), F.col("x").alias("y"), F.col("class").alias("yk"))
    own = needed(F.greatest("n", "yn"), q, least) - F.least("common", "yc")  # runs that the hub lacks that the two must share
    enough = F.least("behind", "yb") + F.least("few", "yf") - 1 >= own - _SLACK
    shared = prefix.join(sparse, ["hub", "x"], "left_semi").join(other, (F.col("hub") == F.col("g")) & (F.col("shingle") == F.col("z")) & differ & enough)
    by_shingle = shared.groupBy("hub", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"), F.min(F.least("few", "yf")).alias("few")).where("n >= few")
    return within_hub(here, texts, least, q).union(by_shingle.select("a", "b")).union(by_block).distinct()


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, digest, class_digest) of each document (doc_id, text); class_id is the smallest id in its
    class, digest a 128-bit hash of the text, and class_digest that of the text that stands for the class: the row
    with this id and text.

    Texts are linked if a banded alignment of their words finds an edit similarity of at least `least` (more than 0.6);
    classes are connected components. Candidates share a sample of their order min-hash sketches, or, if they are short, what is
    left of them without a word or two. Equal texts are one node. In each bucket of equal samples, every text is held
    against the bucket's hub, the text that shares most samples with others. What has not joined its hub's class is then
    held against all others of the hub's buckets that it may still be linked to, as beyond_hub() says. So any two texts of
    a bucket are compared unless they already are in one class or cannot be near.

    Null text is empty; texts without words are one class. Null ids take part, but name a class only
    if it has no other id. Repeated rows are copies. Very long texts are compared whole, pair by pair in slices of
    bounded size. An empty table gives no rows. Other columns are ignored.
    """
    first = _sketches(docs).groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("samples").alias("samples"))
    nodes = checkpointed(first.withColumn("node", F.monotonically_increasing_id()))  # numbers that no two texts share
    spots = nodes.select("node", F.posexplode("samples").alias("sample", "value"))
    spots = spots.select("node", (F.col("sample") >= SAMPLES).alias("short"), F.xxhash64(F.least("sample", F.lit(SAMPLES)), "value").alias("bucket"))
    full = spots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(spots.join(full, "bucket"))
    wanted = nodes.select("digest", "node").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), _digest("text").alias("digest"))
    texts = checkpointed(texts.join(wanted, "digest").dropDuplicates(["node"]).select("node", "text"))

    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).getField("node").alias("hub"))
    pairs = members.join(hubs, "bucket").where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = checkpointed(pairs.agg(F.max("short").alias("short"), F.min("short").alias("only")))
    tried = checkpointed(verified(pairs.select("a", "b"), texts, least).join(pairs, ["a", "b"]))
    links = tried.where("link").select("a", "b")
    joined = checkpointed(connected_components(links))

    def class_of(name: str, out: str) -> DataFrame:
        return joined.select(F.col("node").alias(name), F.col("component").alias(out))

    star = tried.join(class_of("a", "ca"), "a", "left").join(class_of("b", "cb"), "b", "left").join(nodes.select(F.col("node").alias("b"), "n"), "b")
    own, hub = F.coalesce("cb", "b"), F.coalesce("ca", "a")
    star = checkpointed(star.select(F.col("a").alias("hub"), F.col("b").alias("x"), "n", "common", (own == hub).alias("inside"), own.alias("class"), "short", "only"))
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    star = star.withColumn("common", F.col("common")[0])
    more = checkpointed(beyond_hub(star, texts, least, 1).join(done, ["a", "b"], "left_anti"))
    classes = connected_components(links.union(verified(more, texts, least).where("link").select("a", "b")))

    of = nodes.select("node", "digest", "first").join(classes, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
    of = checkpointed(of)
    least_row = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest"))  # a null id comes last
    final = of.join(of.groupBy("component").agg(least_row.alias("least")), "component").select("digest", F.col("least.first").alias("class_id"), F.col("least.digest").alias("class_digest"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("digest"))
    return rows.join(final, "digest").select("doc_id", "class_id", "digest", "class_digest")
