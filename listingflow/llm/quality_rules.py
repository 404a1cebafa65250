"""Quality rules run as a short-circuit cascade, cheapest rejections first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from .common import WORD, checkpointed, in_chunks, remembered, spread, texts_of, words_of

#: Common English insults, for texts of a table without labels; see toxic_terms().
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "clown", "trash", "garbage", "scum", "worthless", "pathetic", "disgusting", "filthy", "vile", "imbecile", "jerk")

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_INSULTS = frozenset(INSULTS)
_UPPER = np.array([chr(c).isupper() for c in range(0x10000)] + [False])
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)] + [False])


class Text:
    """A text with the measures that rules ask for; each is computed once, when first asked for."""

    def __init__(self, text: str, lang: str = ""):
        self.text, self.lang = text, lang

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def full_lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x and WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.full_lines) - len(set(self.full_lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a three-word window that occurs at least twice, its first occurrence included."""
        if self.n_words < 4:
            return 0
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, self.n_words)
        _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)  # small again, so that no product overflows
        _, back, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        again = (counts > 1)[back]
        covered = np.zeros(self.n_words, bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def codes(self) -> np.ndarray:
        return np.minimum(np.frombuffer(self.text.encode("utf-32-le", "replace"), "<u4"), 0x10000)

    @cached_property
    def n_upper(self) -> int:
        return int(np.count_nonzero(_UPPER[self.codes]))

    @cached_property
    def n_letters(self) -> int:
        return int(np.count_nonzero(_LETTER[self.codes]))


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text to refuse."""

    name: str
    rejects: Callable[[Text], bool]


#: What any text must meet first; the digest query reports it as base_failed.
BASE = (
    Rule("short", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)

RULES = (
    Rule("symbols", lambda t: t.n_symbols > 0.1 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 20 * t.n_words),
    Rule("shouting", lambda t: t.n_upper > 0.3 * t.n_letters),
    Rule("few_letters", lambda t: t.n_letters < 0.5 * t.word_chars),
    Rule("dup_lines", lambda t: 2 * t.n_dup_lines > len(t.full_lines)),
    Rule("insults", lambda t: many_of(t, _INSULTS)),
)


def term_of(word: str) -> str:
    return word.strip(".,;:!?\"'()").lower()


def many_of(t: Text, terms: frozenset[str]) -> bool:
    """Whether two words and one of 500 are among the terms; a long text isn't refused for two."""
    n = sum(term_of(w) in terms for w in t.words)
    return n >= 2 and 500 * n >= t.n_words


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, data) of rows (doc_id, text, lang): each whole text by zstd, null as empty."""
    zstd = zstandard.ZstdCompressor(level=1)
    for batch in in_chunks(batches):
        data = [zstd.compress(x.encode()) for x in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], names=["doc_id", "lang", "data"])


def toxic_terms(docs: DataFrame, labels: DataFrame, least: int = 3, share: float = 0.002) -> dict[str, frozenset[str]]:
    """Terms by language that labels (doc_id, toxic) show to be toxic: in `least` toxic documents (doc_id, text, lang) and a
    `share` of those of the language, and in 20 times as many toxic as clean ones.

    Each language is judged by itself, so what one has doesn't push out terms of another, and it has at most (mean
    distinct terms of its toxic documents) / share terms, however large the table is.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    # Labels grow with the documents, so both sides are shuffled at any size; texts go compressed.
    rows = texts.mapInArrow(_compressed, "doc_id long, lang string, data binary").join(known.hint("merge"), "doc_id").select("data", "lang", "toxic")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "data", size=1 << 20):
            n: dict[tuple[str, str], list[int]] = {}
            for data, lang, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                for term in set(map(term_of, words_of(zstandard.decompress(data).decode()))) | {""}:  # the empty term counts texts
                    n.setdefault((lang, term), [0, 0])[toxic > 0] += 1
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in n], pa.string()), "term": pa.array([k[1] for k in n], pa.string()), "clean": pa.array([v[0] for v in n.values()], pa.int64()), "toxic": pa.array([v[1] for v in n.values()], pa.int64())})

    totals = rows.mapInArrow(counted, "lang string, term string, clean long, toxic long").groupBy("lang", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    out: dict[str, set[str]] = {}
    totals = checkpointed(totals.where(f"term = '' OR toxic >= {least} AND toxic >= 20 * clean"))
    texts_of_lang = totals.where("term = ''").select("lang", F.col("toxic").alias("texts"))  # a row per language
    for r in totals.where("term <> ''").join(texts_of_lang, "lang").where(F.col("toxic") >= share * F.col("texts")).select("lang", "term").collect():
        out.setdefault(r["lang"], set()).add(r["term"])
    return {lang: frozenset(terms) for lang, terms in out.items()}


def with_terms(toxic: dict[str, frozenset[str]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules with these terms by language for insults."""
    none: frozenset[str] = frozenset()
    return [Rule("insults", lambda t: many_of(t, toxic.get(t.lang, none))) if r.name == "insults" else r for r in rules]


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000, base: Sequence[Rule] = BASE) -> list[Rule]:
    """The rules by rejections per second of cost, as timed on a sample of about `sample_rows` rows, chosen by hash from
    all of the table: those of them that pass the base, as no others meet a rule.

    After each choice the rest are judged anew, on texts that the chosen ones let pass, and measures that a chosen rule has
    taken cost nothing more. The order decides how soon a bad text is given up, never which texts are kept.
    """

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text and rule: whether it rejects, seconds with and without its measures at hand, and the measures it takes."""
        for batch in in_chunks(batches):
            rows = []
            for text, lang in zip(texts_of(batch), texts_of(batch, "lang")):
                if any(r.rejects(Text(text, lang)) for r in base):
                    continue
                for k, rule in enumerate(rules):
                    t = Text(text, lang)
                    for r in base:
                        r.rejects(t)
                    had, began = set(vars(t)), time.perf_counter()
                    hit = rule.rejects(t)
                    cold, began = time.perf_counter() - began, time.perf_counter()
                    rule.rejects(t)
                    rows.append((k, bool(hit), cold, time.perf_counter() - began, sorted(set(vars(t)) - had)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.string())))], names=["rule", "hit", "cold", "warm", "takes"])

    every = max(1, docs.count() // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 32)), F.lit(every)) == 0)
    found = sample.select("text", _lang(docs)).mapInArrow(timed, "rule long, hit boolean, cold double, warm double, takes array<string>").collect()  # timed where the rows lie
    n = len(found) // max(1, len(rules))
    shape = (n, len(rules))  # a text's rules come one after the other
    hits, cold, warm = (np.array([r[c] for r in found], t).reshape(shape) for c, t in (("hit", bool), ("cold", float), ("warm", float)))
    takes = [set().union(*(found[i * len(rules) + k]["takes"] for i in range(n))) for k in range(len(rules))]
    order, alive, known = [], np.ones(n, bool), set()
    while len(order) < len(rules):
        rest = [k for k in range(len(rules)) if k not in order]
        cost = {k: (cold if takes[k] - known else warm)[alive, k].sum() + 1e-6 for k in rest}
        best = max(rest, key=lambda k: ((hits[alive, k].sum() + 0.5) / cost[k], -k))
        order.append(best)
        alive &= ~hits[:, best]
        known |= takes[best]
    return [rules[k] for k in order]


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, carry: Sequence[str] = ()) -> DataFrame:
    """Measures and verdict of each document (doc_id, text): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, rejected_by (the first rule in the cascade's order
    that refused it, null if kept), then the columns named by `carry`. A document that fails the base, or a
    rule, meets no later rule.

    Null and empty texts have zero measures and fail the base. Repeated rows and null ids are judged
    row by row. An empty table gives no rows. `lang`, where there is one,
    chooses the terms of with_terms(); other columns are ignored.
    """
    ordered = order_rules(docs, rules, base=base)
    rows = docs.select(F.col("doc_id").cast("long"), "text", _lang(docs), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    schema = StructType([rows.schema["doc_id"]])
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, LongType())
    schema = schema.add("base_failed", BooleanType()).add("kept", BooleanType()).add("rejected_by", StringType())
    schema = StructType([*schema.fields, *(docs.schema[c] for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("quality_rules")
        for batch in in_chunks(batches):
            rows = []
            for body, lang in zip(texts_of(batch), texts_of(batch, "lang")):
                t = Text(body, lang)
                failed = next((r.name for r in base if r.rejects(t)), None)
                by = failed or next((r.name for r in ordered if r.rejects(t)), None)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed is not None, by is None, by))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3:]], names=schema.names)

    return spread(rows).mapInArrow(run, schema)
