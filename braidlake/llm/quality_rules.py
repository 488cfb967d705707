"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measurements`` reads each whole text once; ``ledger`` evaluates every rule once and stores the failure bits with
the measurements. A policy is a name, a version and a mask over rules: applying it, or asking what would change
without one of its rules, reads bits and never texts. ``ablations`` is one aggregate over the ledger.

Nothing here shuffles but that aggregate, whose result is one row for each rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits. A rule that cannot be evaluated (no words) fails with the first.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_words > 0 and 10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines > 0 and 10 * n_dup_lines > 5 * n_lines"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "n_words > 0 and word_chars > 15 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
MILD = Policy("web", 1, ("few_words", "repeated_words", "symbols", "duplicate_lines"))
STRICT = Policy("web", 2, tuple(name for name, _ in RULES))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs free of U+0020 and U+0009..U+000D; characters are code points. Lines are parts between \\n that hold
    a word; a line equal to an earlier one counts in n_dup_lines. n_repeat_words counts the words that lie in a
    window of three words found at least twice in the text. A null text has no words. Other columns are ignored.
    """
    text = F.col("text")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select(
        "doc_id",
        words_of(text).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
    )
    df = df.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) < 4 THEN array() ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END").cast("array<long>").alias("g"),
    )
    df = df.withColumn("s", F.sort_array("g"))
    df = df.withColumn("d", F.array_distinct(F.expr("filter(s, (x, i) -> i > 0 AND x = s[greatest(i - 1, 0)])")))
    # few repeated windows: look each up; many: sort windows with their places, so that no text costs the square of its length
    few = "filter(sequence(0, size(g) - 1), i -> array_contains(d, g[i]))"
    pairs = "sort_array(transform(g, (h, i) -> struct(h, i)))"
    many = "transform(filter(transform(o, (x, i) -> struct(x.i AS p, (i > 0 AND o[greatest(i - 1, 0)].h = x.h) OR (i < size(o) - 1 AND o[least(i + 1, size(o) - 1)].h = x.h) AS r)), x -> x.r), x -> x.p)"
    df = df.withColumn("o", F.expr(f"CASE WHEN size(d) > 48 THEN {pairs} END"))
    df = df.withColumn("p", F.expr(f"CASE WHEN size(d) = 0 THEN array() WHEN size(d) > 48 THEN sort_array({many}) ELSE {few} END").cast("array<int>"))
    covered = "CASE WHEN size(p) = 0 THEN 0 ELSE aggregate(transform(p, (x, i) -> CASE WHEN i = size(p) - 1 THEN 3 ELSE least(3, p[least(i + 1, size(p) - 1)] - x) END), 0, (a, x) -> a + x) END"
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(covered).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``, a long with the bit of each rule that the text fails.

    A row for each row of docs, whatever its id; no rows in, none out. Texts of any length are read whole. A rule is at
    its bound when it says so with < and >: a value equal to the bound passes.
    """
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measurements(docs, id_col, text_col).withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: Policy, to: str = "kept") -> DataFrame:
    """rows with a verdict column: whether none of the policy's rules fails. Texts aren't read again."""
    return rows.withColumn(to, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_only): documents that fail the rule, and that only this rule of the policy rejects.

    Leaving the rule out would keep n_only more documents. An empty ledger gives zeros.
    """
    own = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = [F.struct(F.lit(r).alias("rule"), F.count_if(own.bitwiseAND(F.lit(BIT[r])) != 0).alias("n_failed"), F.count_if(own == BIT[r]).alias("n_only")) for r in policy.rules]
    return rows.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*")


#: Rules that DuckDB evaluates, as the table f.
LEDGER_SQL = """
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN n_words > 0 AND 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines > 0 AND 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
"""
OP2_SQL = f"{LEDGER_SQL} SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, 'web' AS policy, 2 AS policy_version FROM f"
ABLATIONS_SQL = f"{LEDGER_SQL}, p AS (SELECT * FROM (VALUES " + ", ".join(f"('{q.name}', {q.version}, '{r}', {q.mask}, {BIT[r]})" for q in (MILD, STRICT) for r in q.rules) + ") v(policy, policy_version, rule, mask, bit)) SELECT policy, policy_version, rule, count(*) FILTER ((failed & bit) <> 0) AS n_failed, count(*) FILTER ((failed & mask) = bit) AS n_only FROM p LEFT JOIN f ON true GROUP BY 1, 2, 3"
