"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit for each rule; a policy is a versioned mask, so
applying another version, or asking what a rule alone rejects (ablation), is bitwise arithmetic over the ledger and reads no text again.

Null text: no words, so it fails the base rules. Null doc_id: as any other. Repeated rows: each its own row. Very long texts: whole. Ties: rules count
alike. Extra columns, whatever their names: not read by the ledger; accepted keeps them. Empty table: no rows.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, map_columns, small_batches, with_columns, words_of

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long, n_marks long, top_word long"

#: Bit, name, and when the rule fails, over the measurements. Append only: ledgers hold these bits.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("capitals", "100 * n_upper > 60 * n_letters"),
    ("exclamations", "100 * n_marks > 50 * n_words"),
    ("one_word", "100 * top_word > 35 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Versioned policies: the rules whose failure rejects.
POLICIES = {"base": BASE, "v1": (1 << len(RULES)) - 1}
CURRENT = "v1"

_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    repeat = 0
    if len(ids) > 3:
        n = len(seen)
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        _, back, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
        hit = count[back] > 1
        cover = np.zeros(len(ids), bool)
        for k in range(3):
            cover[k : len(hit) + k] |= hit
        repeat = int(cover.sum())
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    upper = sum(map(text.count, ascii_uppercase))
    letters = upper + sum(map(text.count, ascii_lowercase))
    return (
        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat,
        len(lines), letters, upper, text.count("!"), int(np.bincount(ids).max()) if words else 0,
    )


NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def bits(prefix: str = "") -> Column:
    """The failure bits, over measurements that are columns, or fields of the column named by a prefix."""
    total = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        rule = re.sub(rf"\b({'|'.join(NAMES)})\b", rf"{prefix}\1", rule)
        total = total + F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return total


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits."""

    def make():
        return lambda c: {"doc_id": c["doc_id"]} | dict(zip(NAMES, zip(*map(measure, c["text"])), strict=True))

    measured = map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f"doc_id long, {MEASURES}", make)
    return measured.withColumn("fail_bits", bits())


def with_ledger(docs: DataFrame, out: str) -> DataFrame:
    """docs with a column of the measurements and one, named out with _bits, of the failure bits."""

    def make():
        return lambda c: {out: [dict(zip(NAMES, measure(t), strict=True)) for t in c["text"]]}

    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in MEASURES.split(", "))
    return with_columns(docs, ["text"], f"`{out}` struct<{fields}>", make).withColumn(f"{out}_bits", bits(f"`{out}`."))


def fails(mask: int, column: str = "fail_bits") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask).cast("long")) != 0


def decide(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return book.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(POLICIES[version] | BASE))


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects. Bits are counted once for each distinct mask."""
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [(name, bit) for name, bit in BITS.items() if bit & POLICIES[version]]
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names]))
    hit = masks.select("bits", "n", rule.alias("r")).select("bits", "n", "r.*")
    return hit.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
        F.max(F.lit(version)).alias("version"),
    )


def accepted(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents, with all their columns, whose ledger a policy keeps."""
    book = free_name(docs, "ledger")
    return with_ledger(docs, book).where(~fails(POLICIES[version] | BASE, f"{book}_bits")).select(docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    book = decide(ledger(documents(spark, sf_dir)))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return book.select(*first, *[c for c in book.columns if c not in first])


_BLANK = r"[ \t\n\x0b\f\r]"
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT r, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') AS l FROM d)),
 g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
 h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1) GROUP BY r),
 c AS (SELECT r, sum(n) AS n, max(n) AS top FROM (SELECT r, w, count(*) AS n FROM w GROUP BY r, w) GROUP BY r),
 m AS (SELECT doc_id, coalesce(c.n, 0) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(h.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, coalesce(top, 0) AS top_word
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS l FROM d) LEFT JOIN c USING (r) LEFT JOIN h USING (r)),
 b AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))} AS bits FROM m)
SELECT doc_id, {", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in NAMES)}, bits & {BASE} <> 0 AS base_failed, bits & {POLICIES[CURRENT] | BASE} = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits FROM b"""
