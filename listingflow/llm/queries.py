"""Digest queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .centroid_clusters import cluster_vectors
from .common import bucket_of, documents
from .fingerprints import fingerprint_pairs
from .lm_scoring import score_texts
from .order_minhash import near_duplicates
from .packing import pack
from .personal_data import find_personal_data, listed
from .quality_classifier import score_quality
from .quality_rules import apply_rules, toxic_terms, with_terms
from .sharding import assign_shards
from .substring_dedup import dedup_passages
from .suffix_dedup import dedup_bytes
from .vector_codes import encode_vectors, with_label_errors


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    toxic = toxic_terms(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, with_terms(toxic)).drop("rejected_by")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = dedup_passages(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of(F.col("doc_id")) % 4 == 2
    scores = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of(F.col("doc_id")) % 10 == 0
    scores = score_texts(documents(spark, sf_dir), ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), 40).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_bytes(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 0.8).select("doc_id", "class_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint_pairs(documents(spark, sf_dir))
    return pairs.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("personal", lambda s: s["base"])
    found = find_personal_data(documents(spark, sf_dir)).withColumn("base", base)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("personal")).alias("spans"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    entries = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(entries).alias("codebooks_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return clusters.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_order_minhash": op9_order_minhash,
    "op10_fingerprints": op10_fingerprints,
    "op11_personal_data": op11_personal_data,
    "op12_vector_codes": op12_vector_codes,
    "op13_centroid_clusters": op13_centroid_clusters,
}

_RUNS = """
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM marked),
numbered AS (SELECT r, i, sum(CASE WHEN i - before <= {size} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits),
runs AS (SELECT r, min(i) AS a, max(i) + {size} AS b FROM numbered GROUP BY r, run),
cuts AS (SELECT r, a, b FROM runs UNION ALL SELECT r, n AS a, n AS b FROM d),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS a, a AS b FROM cuts),
gone AS (SELECT r, sum(b - a) AS n, count(*) AS runs FROM runs GROUP BY r)
"""

_PASSAGES = r"""
WITH d AS (SELECT *, len(w) AS n FROM (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents)),
windows AS (SELECT r, unnest(range(0, n - 34)) AS i, unnest(list_transform(range(0, n - 34), lambda k: md5_number(array_to_string(w[k + 1 : k + 35], ' ')))) AS h FROM d WHERE n >= 35),
marked AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
""" + _RUNS.format(size=35) + """,
kept AS (SELECT r, string_agg(array_to_string(w[gaps.a + 1 : gaps.b], ' '), ' ' ORDER BY gaps.a) AS t FROM gaps JOIN d USING (r) WHERE gaps.b > gaps.a GROUP BY r)
SELECT doc_id, d.n AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

_BYTES = """
WITH d AS (SELECT *, strlen(x) // 2 AS n FROM (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)),
starts AS (SELECT *, unnest(range(0, n - 49, 200)) AS o FROM d WHERE n >= 50),
parts AS (SELECT r, doc_id, o, substr(x, 2 * o + 1, 498) AS y FROM starts),
windows AS (SELECT r, doc_id, o + unnest(range(0, strlen(y) // 2 - 49)) AS i, unnest(list_transform(range(0, strlen(y) // 2 - 49), lambda k: md5_number(substr(y, 2 * k + 1, 100)))) AS h FROM parts),
least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING count(*) > 1),
marked AS (SELECT r, i FROM windows JOIN least USING (h) WHERE first < doc_id),
""" + _RUNS.format(size=50) + """,
kept AS (SELECT r, string_agg(substr(x, 2 * gaps.a + 1, 2 * (gaps.b - gaps.a)), '' ORDER BY gaps.a) AS t FROM gaps JOIN d USING (r) WHERE gaps.b > gaps.a GROUP BY r)
SELECT doc_id, d.n AS n_bytes, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, coalesce(gone.runs, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x{10000}-\x{10FFFF}]', '', 'g') AS low,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
terms AS (SELECT r, doc_id, lang, unnest(list_transform(w, lambda x: lower(trim(x, '.,;:!?"''()')))) AS term FROM d),
seen AS (SELECT DISTINCT r, lang, term, toxic > 0 AS bad FROM terms JOIN known USING (doc_id) WHERE term <> ''),
counted AS (SELECT lang, term, count(*) FILTER (bad) AS bad, count(*) FILTER (NOT bad) AS clean FROM seen GROUP BY lang, term),
texts AS (SELECT coalesce(lang, '') AS lang, count(*) FILTER (toxic > 0) AS n FROM d JOIN known USING (doc_id) GROUP BY 1),
toxic AS (SELECT lang, term FROM counted JOIN texts USING (lang) WHERE bad >= 3 AND bad >= 20 * clean AND bad >= CAST(0.002 AS DOUBLE) * n),
hits AS (SELECT r, count(*) AS hits FROM terms JOIN toxic USING (lang, term) GROUP BY r),
windows AS (SELECT r, unnest(range(0, len(w) - 2)) AS i, unnest(list_transform(range(0, len(w) - 2), lambda k: array_to_string(w[k + 1 : k + 3], ' '))) AS g FROM d WHERE len(w) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS o(k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(again.n, 0) AS n_repeat_words,
  length(regexp_replace(low, '[^\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(low, '[^\p{L}]', '', 'g')) AS letters, coalesce(hits, 0) AS hits
  FROM d LEFT JOIN again USING (r) LEFT JOIN hits USING (r)),
b AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > CAST(0.1 AS DOUBLE) * n_words OR word_chars > 20 * n_words OR upper > CAST(0.3 AS DOUBLE) * letters OR 2 * letters < word_chars
    OR 2 * n_dup_lines > len(lines) OR (hits >= 2 AND 500 * hits >= n_words)) AS kept FROM b
"""

_SHARDS = """
WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS x,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS UHUGEINT) AS key FROM documents),
e AS (SELECT r, doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM d, steps),
jumps(r, n, key, shard, ahead) AS (SELECT r, n, key, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d, (VALUES (40), (41)) AS v(n)
  UNION ALL SELECT r, n, next, ahead, CAST(floor((ahead + 1) * (CAST(2147483648 AS DOUBLE) / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (key * CAST(2862933555777941757 AS UHUGEINT) + 1) % CAST('18446744073709551616' AS UHUGEINT) AS next FROM jumps WHERE ahead < n)),
s AS (SELECT r, CAST(max(shard) FILTER (n = 40) AS INTEGER) AS shard, CAST(max(shard) FILTER (n = 41) AS INTEGER) AS grown_shard FROM jumps GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM e JOIN s USING (r)
"""

_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({d}[-i] AS INTEGER) WHEN CAST({d}[-i] AS INTEGER) > 4 THEN 2 * CAST({d}[-i] AS INTEGER) - 9 ELSE 2 * CAST({d}[-i] AS INTEGER) END)) % 10 = 0"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_CARD = f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN " + _LUHN.format(d=_DIGITS) + " ELSE false END"
_ACCOUNT = """CASE WHEN length(replace(m, ' ', '')) BETWEEN 15 AND 34 THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(m, 4), ''),
  lambda c: CAST(ascii(c) AS BIGINT))), lambda n, c: CASE WHEN c < 58 THEN (10 * n + c - 48) % 97 ELSE (100 * n + c - 55) % 97 END) = 1 ELSE false END"""
_APART = "NOT regexp_matches(first, '{x}') AND NOT regexp_matches(right(before, 1), '{x}')"
_PHONE_NEAR = "regexp_matches(lower(before), 'phone|tel[.:]|call|mobile|cell|fax|telefon|handy|anruf|teléfono|llama|móvil|téléphone|portable|appel')"
#: Step, rank, kind, pattern, test and test of context, as the operator's kinds have them; each step gives way to the steps before.
_SPANS = (
    (0, 0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (0, 1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || left(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0"),
    (0, 2, "card", r"[0-9]([\x20-]?[0-9])+", _CARD),
    (0, 3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    (1, 4, "iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", f"{_APART.format(x='[A-Za-z0-9]')} AND {_ACCOUNT}"),
    (1, 5, "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{_APART.format(x='[A-Za-z0-9]')} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(before), 'ssn|social security|sozialversicherung|seguridad social|sécurité sociale')"),
    (1, 2, "card", r"[0-9]{4}(?:[ -][0-9]{4}){3}", f"{_APART.format(x='[A-Za-z0-9]')} AND {_CARD}"),
    (1, 3, "phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{3,4}){2}", _APART.format(x="[A-Za-z0-9]")),
    (2, 3, "phone", r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", f"{_APART.format(x='[+0-9A-Za-z]')} AND {_PHONE_NEAR}"),
)


def _personal_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT r, {step} AS step, {rank} AS rank, '{kind}' AS kind, a, a + length(m) AS b FROM (
  SELECT r, m, right(g, 40) AS before, left(coalesce(next, ''), 1) AS first, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY k) - coalesce(length(m), 0) AS a FROM (
    SELECT r, k, g, m, lead(g) OVER (PARTITION BY r ORDER BY k) AS next FROM (
      SELECT r, unnest(range(1, len(gs) + 1)) AS k, unnest(gs) AS g, unnest(list_resize(ms, len(gs))) AS m FROM (SELECT r, string_split_regex(text, '{pattern}') AS gs, regexp_extract_all(text, '{pattern}') AS ms FROM d)))
  ) WHERE m IS NOT NULL AND {test}"""
        for step, rank, kind, pattern, test in _SPANS
    )
    clash = "NOT EXISTS (SELECT 1 FROM {t} o WHERE o.r = f.r AND o.rank = f.rank AND o.a < f.b AND f.a < o.b)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS MATERIALIZED ({parts}),
base AS MATERIALIZED (SELECT * FROM found WHERE step = 0),
one AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM found f WHERE step = 1 AND {clash.format(t='base')}),
spans AS (SELECT * FROM one UNION ALL SELECT * FROM found f WHERE step = 2 AND {clash.format(t='one')}),
told AS (SELECT r, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans, coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (step = 0), '') AS base,
  {", ".join(f"count(*) FILTER (step = 0 AND rank = {i}) AS n_{kind}" for i, kind in enumerate(("email", "ip", "card", "phone")))} FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
"""


#: Exact floor of s / n.
_MEAN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    kept = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = "".join(
        f"""
d{t} AS MATERIALIZED (SELECT r, p, arg_min(e, 100 * d + e) AS e, min(d) AS d FROM (SELECT r, p, e, sum((a.x - b.x) * (a.x - b.x)) AS d FROM c a JOIN b{t} b USING (p, i) GROUP BY r, p, e) GROUP BY r, p),"""
        + (f"""
b{t + 1} AS MATERIALIZED (SELECT p, e, i, coalesce({_MEAN}, x) AS x FROM b{t} LEFT JOIN (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM c JOIN d{t} USING (r, p) GROUP BY p, e, i) USING (p, e, i)),""" if t < rounds else "")
        for t in range(rounds + 1)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings WHERE {kept}),
c AS MATERIALIZED (SELECT r, i // w AS p, i % w AS i, x FROM (SELECT r, w, unnest(range(0, len(embedding))) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM v)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x FROM c WHERE r <= {entries}),{steps}
told AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN told USING (r), books
"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    kept = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = "".join(
        f"""
d{t} AS MATERIALIZED (SELECT r, arg_min(j, 100 * d + j) AS j, min(d) AS d FROM (SELECT r, j, sum((a.x - b.x) * (a.x - b.x)) AS d FROM c a JOIN b{t} b USING (i) GROUP BY r, j) GROUP BY r),"""
        + (f"""
b{t + 1} AS MATERIALIZED (SELECT j, i, coalesce({_MEAN}, x) AS x FROM b{t} LEFT JOIN (SELECT j, i, sum(x) AS s, count(*) AS n FROM c JOIN d{t} USING (r) GROUP BY j, i) USING (j, i)),""" if t < rounds else "")
        for t in range(rounds + 1)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) AS r, vec_id, embedding FROM embeddings WHERE {kept}),
c AS MATERIALIZED (SELECT r, unnest(range(0, 64)) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM v),
b0 AS MATERIALIZED (SELECT r - 1 AS j, i, x FROM c WHERE r <= {k}),{steps}
names AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM b{rounds} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM v JOIN d{rounds} USING (r) JOIN names USING (j)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": _RULES,
    "op3_substring_dedup": _PASSAGES,
    "op6_sharding": _SHARDS,
    "op8_suffix_dedup": _BYTES,
    "op11_personal_data": _personal_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_centroid_clusters": _clusters_sql(),
}
