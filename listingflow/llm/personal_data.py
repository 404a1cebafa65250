"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move their score.

Everything is built-in functions on one row at a time: no shuffle, no Python. A text's matches and the gaps between
them come from the same pattern (`regexp_extract_all` and `split`), so a span's place is the sum of what stands before it.

Null texts count as empty; ids may be null or repeat, and each row is judged by itself; an empty table gives an
empty one; of the input only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a match that are searched for context words.
NEAR = 40

#: An added span needs this score; base spans stay at any.
LEAST_SCORE = 0.6

#: Lengths summed up at a time, so that the running sums of a text with many matches don't grow with their square.
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of span. The pattern's matches that `valid` confirms score `score`, and `near` more where `context` matches before them.

    Patterns use possessive repeats and look-behinds only where these find the same matches as the plain ones: without
    them Java would recurse over long groups, or try each place of a long run anew. `hint` is a text without which
    there is no match.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str = ""
    near: float = 0.0
    base: bool = True
    hint: str = ""
    #: What may not stand right before or after an added span.
    beside: str = "[A-Za-z0-9]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test: from the right, every second digit is doubled and cast out by nines."""
    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))

    def weighed(at: Column) -> Column:
        digit = F.ascii(F.substr(digits, -at, F.lit(1))) - 48
        return F.when(at % 2 == 1, digit).otherwise(F.get(doubled, digit))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, at: total + weighed(at)) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 by 97 with its first four characters at the end and letters as 10 to 35."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, at: Column) -> Column:
        code = F.ascii(F.substr(moved, at, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), step) == 1


def _byte(part: Column) -> Column:
    """Whether a string of digits is at most 255."""
    least = F.ltrim(part, F.lit("0"))
    return (F.length(least) <= 3) & (F.concat(F.lit("0"), F.substr(least, F.lit(1), F.lit(3))).cast("int") <= 255)


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def _account(match: Column) -> Column:
    account = F.regexp_replace(match, " ", "")
    return F.when(F.length(account).between(15, 34), mod_97(account)).otherwise(False)


def _social(match: Column) -> Column:
    """Numbers that were ever given out: no part is all zeros, and the first is neither 666 nor 900 or more."""
    return ~match.rlike("^(000|666|9)|-00-|-0000$")


PHONE_WORDS = "phone|tel[.:]|call|mobile|cell|fax|telefon|handy|anruf|teléfono|llama|móvil|téléphone|portable|appel"
#: Kinds in the order in which spans at one start are listed: those of the base first.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, "mail|contact|kontakt|correo|courriel", 0.1, hint="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.forall(F.split(m, r"\."), _byte), 0.6, r"\bip\b|host|server|addr|login", 0.3, hint="."),
    Kind("card", r"[0-9](?:[ -]?+[0-9]){11,}+", _card, 0.8, "card|visa|credit|karte|tarjeta|carte", 0.2),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.7, PHONE_WORDS, 0.3, hint="+"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _account, 0.9, "iban|bank|konto|cuenta|compte|account", 0.1, base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _social, 0.3, "ssn|social security|sozialversicherung|seguridad social|sécurité sociale", 0.5, base=False, hint="-"),
    Kind("card", r"[0-9]{4}(?:[ -][0-9]{4}){3}", _card, 0.8, "card|visa|credit|karte|tarjeta|carte", 0.2, base=False),
    Kind("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{3,4}){2}", lambda m: F.lit(True), 0.6, PHONE_WORDS, 0.3, base=False, hint="+"),
    Kind("phone", r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", lambda m: F.lit(True), 0.3, PHONE_WORDS, 0.4, base=False, beside="[+0-9A-Za-z]"),
)
BASE = tuple(dict.fromkeys(k.name for k in KINDS if k.base))


def _scan(lengths: Column, start: Column) -> Column:
    """start, and start plus each leading part of an array, without the sum of all."""
    seed = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("seen"))
    return F.aggregate(lengths, seed, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")))["seen"]


def running_sums(lengths: Column) -> Column:
    """For each item of an array of longs the sum of those before it; in blocks, whose sums are summed up in turn."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _BLOCK) - 1, F.lit(0)).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), _scan(sums, F.lit(0)).alias("start")), lambda z: _scan(z["block"], z["start"])))


def _placed(kind: Kind, rank: int, matches: str, gaps: str, places: str) -> Column:
    """Confirmed spans (start, rank, kind, end, score, base) out of a text's matches, the gaps between them and the places where gaps begin."""
    items = F.transform(
        F.arrays_zip(F.col(matches).alias("match"), F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), F.slice(gaps, F.lit(2), F.size(matches)).alias("next"), F.col(places).alias("at")),
        lambda z: F.struct(z["match"].alias("match"), z["gap"]["before"].alias("before"), z["next"]["first"].alias("first"), (z["at"] + z["gap"]["n"]).alias("start")),
    )

    def scored(z: Column) -> Column:
        near = F.when(F.lower(z["before"]).rlike(kind.context), F.lit(kind.near)).otherwise(F.lit(0.0)) if kind.context else F.lit(0.0)
        return F.struct(
            z["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (z["start"] + F.length(z["match"])).alias("end"),
            F.round(F.lit(kind.score) + near, 2).alias("score"), F.lit(kind.base).alias("base"),
        )

    def holds(z: Column) -> Column:
        if kind.base:
            return kind.valid(z["match"])
        return ~z["first"].rlike(kind.beside) & ~F.substr(z["before"], F.lit(-1)).rlike(kind.beside) & kind.valid(z["match"])

    spans = F.transform(F.filter(items, holds), scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


def find_personal_data(docs: DataFrame, carry: Sequence[str] = (), kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """(doc_id, text, carry..., personal): spans (start, rank, kind, end, score, base) of each text, in the order of start and rank.

    Places are code points, the end is exclusive. Spans of one kind don't overlap: base spans stay, and an added
    span goes if it overlaps one of its kind that was found before it. Spans of different kinds may overlap. Text is null only where it was null.
    """
    ranks = {name: i for i, name in enumerate(dict.fromkeys(k.name for k in kinds))}
    kept = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    may = F.col("text").rlike("[0-9]") | F.contains("text", F.lit("@"))  # else there is no match of any kind
    at = docs.select("doc_id", F.col("text").alias("given"), F.when(may, F.col("text")).otherwise("").alias("text"), *kept)
    none, numbers = F.array().cast("array<string>"), range(len(kinds))
    found = [F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)) for k in kinds]
    at = at.select("*", *((F.when(F.contains("text", F.lit(k.hint)), m).otherwise(none) if k.hint else m).alias(f"matches_{i}") for i, (k, m) in enumerate(zip(kinds, found))))

    def gaps(k: Kind) -> Column:
        return F.transform(F.split("text", k.pattern, -1), lambda x: F.struct(F.length(x).alias("n"), F.substr(x, F.greatest(F.length(x) - NEAR + 1, F.lit(1)), F.lit(NEAR)).alias("before"), F.substr(x, F.lit(1), F.lit(1)).alias("first")))

    at = at.select("*", *(F.when(F.size(f"matches_{i}") > 0, gaps(k)).alias(f"gaps_{i}") for i, k in enumerate(kinds)))
    lengths = [F.zip_with(f"matches_{i}", F.slice(f"gaps_{i}", F.lit(1), F.size(f"matches_{i}")), lambda m, g: (F.length(m) + g["n"]).cast("long")) for i in numbers]
    at = at.select("*", *(F.when(F.size(f"matches_{i}") > 0, x).alias(f"lengths_{i}") for i, x in enumerate(lengths)))
    at = at.select("*", *(F.when(F.size(f"matches_{i}") > 0, running_sums(F.col(f"lengths_{i}"))).alias(f"places_{i}") for i in numbers))
    spans = [F.when(F.size(f"matches_{i}") > 0, _placed(k, ranks[k.name], f"matches_{i}", f"gaps_{i}", f"places_{i}")) for i, k in enumerate(kinds)]
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,base:boolean>>")
    at = at.select("doc_id", "given", *(f"carried_{i}" for i in range(len(carry))), *(F.coalesce(s, empty).alias(f"spans_{i}") for i, s in enumerate(spans)))
    at = at.withColumn("personal", F.concat(empty, *(f"spans_{i}" for i in numbers if kinds[i].base)))
    for i in numbers:
        if not kinds[i].base:
            at = at.withColumn("personal", F.when(F.size(f"spans_{i}") > 0, F.concat("personal", F.filter(f"spans_{i}", _apart))).otherwise(F.col("personal")))
    return at.select("doc_id", F.col("given").alias("text"), *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)), F.array_sort("personal").alias("personal"))


def _apart(span: Column) -> Column:
    """Whether a span overlaps none of its kind that is there already."""
    return ~F.exists("personal", lambda s: (s["rank"] == span["rank"]) & (s["start"] < span["end"]) & (span["start"] < s["end"]))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(found: DataFrame) -> DataFrame:
    """`found` with each span of the text replaced by its kind in angle brackets; of spans that overlap, the first stands for all."""
    seed = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        before = F.substr("text", (s["at"] + 1).cast("int"), (span["start"] - s["at"]).cast("int"))
        told = F.struct(span["end"].alias("at"), F.concat(s["out"], before, F.lit("<"), span["kind"], F.lit(">")).alias("out"))
        return F.when(span["start"] >= s["at"], told).otherwise(F.struct(F.greatest(s["at"], span["end"]).alias("at"), s["out"].alias("out")))

    cut = F.aggregate("personal", seed, step, lambda s: F.concat(s["out"], F.substr("text", (s["at"] + 1).cast("int"))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), cut))
