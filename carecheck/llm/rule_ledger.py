"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` takes the measurements of every text, ``ledger`` evaluates every rule once and stores one failure
bit per rule beside the measurements. Policies are versioned sets of rules: ``apply_policy`` keeps a row
whose failure bits and the policy's mask have nothing in common, and ``ablation`` tells from the stored bits alone
what each rule of a policy decides. Nothing is evaluated again for a new policy.

A null or empty text has no words: all measurements are 0 and it fails ``few_words``. Texts are read whole.
Repeated rows are judged each by itself; other columns, also with the names made here, are not read
(``ledger`` returns id, measurements and bits only). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rules in bit order; each is the condition of failing, over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "100 * n_upper > 50 * word_chars",
}
BASE = ["few_words", "repeated_words"]
POLICIES: dict[str, list[str]] = {
    "v1": BASE,
    "v2": [*BASE, "many_symbols", "repeated_lines", "short_words", "long_words", "shouting"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def mask(rules: list[str]) -> int:
    """The bits of some rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements per row: words, characters in words, symbols, lines and words that repeat, upper-case letters.

    A repeated word is one in a window of three words found at least twice in the text. Windows are compared by
    64-bit hash; only texts with an equal pair of neighbours in the sorted hashes sort them with their positions.
    """
    none = F.array().cast("array<bigint>")
    texts = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    words = texts.select(
        id_column,
        F.expr(r"filter(split(_text, '[ \\t\\n\\x0B\\f\\r]+', -1), w -> w <> '')").alias("_words"),
        F.expr(r"filter(split(_text, '\\n', -1), l -> l rlike '[^ \\t\\n\\x0B\\f\\r]')").alias("_lines"),
        F.length(F.translate("_text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", UPPER, ""))).cast("bigint").alias("n_upper"),
    )
    windows = words.select(
        id_column, "word_chars", "n_symbols", "n_upper",
        F.size("_words").cast("bigint").alias("n_words"), F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size("_words") >= 3,
            F.expr("transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))"),
        ).otherwise(none).alias("_hashes"),
    )
    order = windows.withColumn("_sorted", F.sort_array("_hashes"))
    again = order.withColumn(
        "_again",
        F.when(
            F.size("_sorted") >= 2,
            F.expr("exists(sequence(1, size(_sorted) - 1), i -> _sorted[i] = _sorted[i - 1])"),
        ).otherwise(False),
    ).drop("_sorted")
    placed = again.withColumn("_placed", F.when(
        F.col("_again"), F.expr("array_sort(transform(_hashes, (h, i) -> struct(h AS h, i AS i)))")
    )).drop("_hashes")
    found = placed.withColumn("_found", F.when(F.col("_again"), F.expr("""
        sort_array(filter(
            transform(_placed, (p, k) -> if(
                coalesce(get(_placed, k - 1).h = p.h, false) OR coalesce(get(_placed, k + 1).h = p.h, false), p.i, -1)),
            i -> i >= 0))"""))).drop("_placed")
    covered = F.expr("""
        aggregate(transform(_found, (i, k) -> least(3, coalesce(get(_found, k + 1) - i, 3))), 0L, (a, x) -> a + x)""")
    repeated = F.coalesce(F.when(F.col("_again"), covered), F.lit(0)).cast("bigint").alias("n_repeat_words")
    # the generator keeps later filters on measurements from being rewritten into their expressions
    return found.select(id_column, F.inline(F.array(F.struct(*[repeated if m == "n_repeat_words" else F.col(m) for m in MEASURES]))))


def ledger(measured: DataFrame) -> DataFrame:
    """The measurements with ``fail_bits``: bit k set where rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total.cast("bigint"))


def failed(rules: list[str], bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(rules)).cast("bigint")) != 0


def apply_policy(ledgered: DataFrame, version: str) -> DataFrame:
    """The ledger with ``policy``, ``base_failed`` and ``kept`` by a policy version."""
    return ledgered.select(
        "*", F.lit(version).alias("policy"), failed(BASE).alias("base_failed"),
        (~failed(BASE) & ~failed(POLICIES[version])).alias("kept"),
    )


def ablation(ledgered: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone (kept without it), and with which others (bits)."""
    whole = mask(POLICIES[version])
    seen = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("bigint"))
    per_bits = ledgered.groupBy(seen.alias("bits")).agg(F.count("*").alias("rows"))  # at most 2**rules rows
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).cast("bigint").alias("bit")) for name in POLICIES[version]
    ])
    return (
        per_bits.select("bits", "rows", F.explode(rules).alias("r"))
        .groupBy(F.lit(version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("rows")).otherwise(0)).alias("rows_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("rows")).otherwise(0)).alias("rows_failed_alone"),
            F.coalesce(F.bit_or(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits"))), F.lit(0)).alias("failed_with"),
        )
    )


def judge(docs: DataFrame, version: str = "v2", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements, failure bits and the policy's verdict per row."""
    return apply_policy(ledger(measure(docs, id_column, text_column)), version)


def keep(docs: DataFrame, version: str = "v2", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that a policy keeps; no shuffle."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_column).alias("_text"))
    return judge(whole, version, "_row", "_text").filter("kept").select("_row.*")


ORACLE_SQL = r"""
WITH t AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t
), windows AS (
    SELECT k, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
    FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
    SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k
), m AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
           (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
    FROM w LEFT JOIN covered ON w.k = covered.k
), l AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN 100 * n_upper > 50 * word_chars THEN 64 ELSE 0 END) AS bits
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper,
       bits::BIGINT AS fail_bits, 'v2' AS policy, bits & 3 <> 0 AS base_failed, bits = 0 AS kept
FROM l
"""
