"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule;
a policy is a bitmask of the rules that reject, so applying a policy, another version of it, or an ablation
is bit arithmetic over the ledger and never looks at a text again. Everything is built-in column functions.

Defined results: a null or blank text has no words, all its measurements are 0 and it fails `few_words`.
Repeated rows are judged row by row. Other columns of the input pass through unless `ledger` is told which to
keep; a column named like a measurement is replaced by it. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import SPACES, let, materialize, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]

# name -> condition of failure over the measurements; the position in this table is the rule's bit
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "n_words >= 10 AND 2 * n_upper > word_chars",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 20 * n_words",
}

# versioned policies: the rules that reject a document
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "shouting", "duplicate_lines", "long_words"],
}


def rule_bit(name: str) -> int:
    return 1 << list(RULES).index(name)


def policy_mask(policy: str | list[str]) -> int:
    """The bitmask of a policy, given by its version name or as a list of rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum({rule_bit(n) for n in names})


def _removed(text: Column, chars: str) -> Column:
    """How many code points of `text` are among `chars`."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_window_words(ws: Column) -> Column:
    """Words that lie in a window of five words which occurs twice or more in the same text.

    Windows are compared by a 64-bit hash of the five words' hashes. Only texts with a repeated window sort
    them: equal windows become neighbours, and a window's new words are those up to the next marked one.
    """

    def windows(h: Column) -> Column:
        ids = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(ids, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def covered(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j)["w"] == x["w"])
            twice = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            new = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(new, F.lit(0), lambda a, x: a + x)

        return let(let(ordered, marked), total)

    def count(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(covered(win))

    return let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), count).cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: kept columns, all measurements and `failed`, the bitmask of failed rules."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in [*MEASURES, "failed"]]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    worded = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")
    found = {
        "n_words": let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("r"))),
        "word_chars": F.length(t).cast("long") - _removed(t, SPACES),
        "n_symbols": _removed(t, SYMBOLS),
        "n_upper": _removed(t, UPPER),
        "n_lines": let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
    }
    # kept columns travel as one, so that no name of theirs can clash
    row = F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep, 1)])
    out = docs.select(row.alias("__row"), *[v.alias(f"__{k}") for k, v in found.items()])
    out = out.select(
        *[F.col(f"__row._{i}").alias(c) for i, c in enumerate(keep, 1)], F.col("__n_words.n").alias("n_words"), F.col("__word_chars").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"), F.col("__n_upper").alias("n_upper"), F.col("__n_lines.n").alias("n_lines"),
        F.col("__n_lines.d").alias("n_dup_lines"), F.col("__n_words.r").alias("n_repeat_words"))
    bits = [F.when(F.expr(cond), F.lit(rule_bit(name))).otherwise(F.lit(0)) for name, cond in RULES.items()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return out.withColumn("failed", mask.cast("long"))


def rejects(failed: Column, policy: str | list[str]) -> Column:
    """True if a document with these failure bits is rejected under the policy."""
    return failed.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) != 0


def ablations(led: DataFrame, policy: str | list[str] = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects.

    Aggregates the ledger to one row per bitmask (at most 2^rules rows) before it looks at single rules.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    masks = led.groupBy(F.col("failed").bitwiseAND(F.lit(policy_mask(policy)).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(rule_bit(n)).cast("long").alias("bit")) for n in names]))
    return masks.withColumn("r", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"))


def keep_good(docs: DataFrame, policy: str | list[str] = "v1", text: str = "text") -> DataFrame:
    """The rows of `docs` that the policy does not reject, with their own columns."""
    led = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text")), "__text", ["__row"])
    return led.filter(~rejects(F.col("failed"), policy)).select("__row.*")


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of `docs`, written once; policies and ablations read bits and measurements, not texts."""
    return materialize(ledger(docs, keep=["doc_id"]), "rule-ledger")


def op5_ablations(docs: DataFrame) -> DataFrame:
    return ablations(stored_ledger(docs), "v1")


def op5(docs: DataFrame) -> DataFrame:
    led = stored_ledger(docs)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        rejects(F.col("failed"), "base").alias("base_failed"), (~rejects(F.col("failed"), "v1")).alias("kept"))


_MEASURED = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents),
win AS (SELECT rid, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
win2 AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), chr(10)) AS k FROM win),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win2) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid))
"""
# the same bits in SQL
_FAILED = " + ".join(f"CASE WHEN {cond} THEN {rule_bit(name)} ELSE 0 END" for name, cond in RULES.items())

ORACLE = f"""{_MEASURED.rstrip()},
f AS (SELECT *, {_FAILED} AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       CAST(failed AS BIGINT) AS failed, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
            OR (n_words >= 10 AND 2 * n_upper > word_chars) OR 2 * n_dup_lines > n_lines
            OR word_chars > 20 * n_words) AS kept
FROM f
"""

ABLATIONS_ORACLE = f"""{_MEASURED.rstrip()},
f AS (SELECT {_FAILED} AS failed FROM m),
r(rule, bit) AS (VALUES {", ".join(f"('{n}', {rule_bit(n)})" for n in POLICIES["v1"])})
SELECT rule, CAST(coalesce(sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_failed,
       CAST(coalesce(sum(CASE WHEN failed = bit THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_only_this FROM r, f GROUP BY rule
"""
