"""The columns of operators that SQL can express, as queries of their own with their SQL.

Each runs its whole operator and keeps the columns that no trained model decides: counts of rules,
spans of patterns, and word probabilities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, ppm, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "list_filter(regexp_split_to_array({}, '[ \\t-\\r]+'), lambda w: w <> '')"
#: Patterns of the base spans as they are stated, and which matches count; ``m`` is a match.
NUMBER = "regexp_replace(m, '[^0-9]', '', 'g')"
PARTS = "list_transform(string_split(m, '.'), lambda p: ltrim(p, '0'))"
LUHN = f"list_sum(list_transform(range(1, length({NUMBER}) + 1), lambda i: list_extract([CAST(x AS INT) * (1 + (i + 1) % 2) - 9 * CAST(i % 2 = 0 AND CAST(x AS INT) > 4 AS INT) FOR x IN [substr(reverse({NUMBER}), i, 1)]], 1))) % 10 = 0"
SPANS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"len(list_filter({PARTS}, lambda p: length(p) > 3 OR coalesce(try_cast(p AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9]([ -]?[0-9])+", f"length({NUMBER}) BETWEEN 13 AND 19 AND {LUHN}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({NUMBER}) BETWEEN 9 AND 15"),
}


def ppm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, known tokens and word probabilities, to four decimals, of all documents."""
    scores = ppm.op1_ppm_score(spark, sf_dir)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def ppm_base_sql() -> str:
    bit = "lambda crc, i: xor(xor(crc, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(k, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END) >> 1, CASE WHEN xor(crc, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(k, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""WITH named AS (SELECT row_number() OVER () AS id, doc_id, CAST(doc_id AS VARCHAR) AS k, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
docs AS (SELECT id, doc_id, w, coalesce(xor(list_reduce(range(0, 8 * length(k)), {bit}, CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 2, true) AS held_out FROM named),
tokens AS (SELECT id, held_out, unnest(list_append(w, '')) AS t FROM docs),
counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
total AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts),
sums AS (SELECT id, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS s FROM tokens LEFT JOIN counts USING (t), total GROUP BY id)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(s, 4) AS base_score FROM docs JOIN sums USING (id), total"""


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digest of the base spans of all documents."""
    return pii.op4_pii(spark, sf_dir).drop("spans")


def pii_base_sql() -> str:
    found = ", ".join(f"regexp_extract_all(x, '{p}') AS {k}_m, list_transform(regexp_split_to_array(x, '{p}'), lambda g: length(g)) AS {k}_g" for k, (p, _) in SPANS.items())
    # A match begins after the gaps up to it and the matches before it.
    start = "list_sum(list_slice({0}_g, 1, i)) + coalesce(list_sum(list_transform(list_slice({0}_m, 1, i - 1), lambda y: length(y))), 0)"
    placed = ", ".join(f"list_transform(range(1, len({k}_m) + 1), lambda i: {{'m': {k}_m[i], 's': CAST({start.format(k)} AS BIGINT)}}) AS {k}" for k in SPANS)
    kept = ", ".join(f"[('{k}:' || r.s || ':' || (r.s + length(r.m))) FOR r IN {k} IF len([m FOR m IN [r.m] IF {valid}]) = 1] AS {k}" for k, (_, valid) in SPANS.items())
    counts = ", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in SPANS)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
found AS (SELECT doc_id, {found} FROM texts),
placed AS (SELECT doc_id, {placed} FROM found),
kept AS (SELECT doc_id, {kept} FROM placed)
SELECT doc_id, {counts}, sha256(array_to_string(list_concat(list_concat(email, ip), list_concat(card, phone)), ',')) AS base_sha256 FROM kept"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the base rules for all documents."""
    return quality.op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_base_sql() -> str:
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS x, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
lined AS (SELECT *, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')) AS lines FROM docs),
windows AS (SELECT id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
again AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) GROUP BY id),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM lined LEFT JOIN covered USING (id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts"""


QUERIES = {f.__name__: f for f in (ppm_base, pii_base, quality_base)}
ORACLES = {"ppm_base": ppm_base_sql(), "pii_base": pii_base_sql(), "quality_base": quality_base_sql()}
