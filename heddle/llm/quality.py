"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and keeps the measurements beside one
integer whose bit i says that rule i failed. A policy is a named, versioned mask over
these bits: judging, comparing and ablating policies only read the ledger.

Null and empty text: zero words, bit 0 set. Repeated rows each get their row, an empty table
none. Texts of any length are measured whole. Ratios are compared in integers, so results do
not depend on rounding. ``filter_documents`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bang_words long, n_digits long"

#: Name and failing condition over the measurements; the place in the list is the bit.
RULES: list[tuple[str, Callable[[Callable[[str], Column]], Column]]] = [
    ("few_words", lambda m: m("n_words") < 50),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    ("symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
    ("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    ("shouting", lambda m: 100 * m("n_bang_words") > 30 * m("n_words")),
    ("digits", lambda m: 100 * m("n_digits") > 30 * m("word_chars")),
]
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "word_length", "symbols", "repeated_lines", "shouting"),
    "web-2": ("few_words", "repeated_words", "word_length", "symbols", "repeated_lines", "shouting", "digits"),
}


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 8
    words = text.encode("utf-8").split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    distinct = set(windows)
    repeated = 0
    if len(distinct) < len(windows):
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        reach = 0  # words before it are counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    bang = sum(w.endswith(b"!") for w in words)
    digits = sum(map(text.count, "0123456789"))
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), bang, digits)


def measure(text: Column) -> Column:
    """Struct of the measurements of a text column."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def measures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure_text(t) for t in texts], columns=names)

    return measures(text)


def failure_bits(measures: str | None = None) -> Column:
    """The rules' bits, over columns or over the fields of a struct column."""
    bits = F.lit(0).cast("long")
    m = lambda name: F.col(f"{measures}.{name}" if measures else name)
    for i, (_, failing) in enumerate(RULES):
        bits = bits + F.when(failing(m), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, every measurement, fail_bits."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    return measured.withColumn("fail_bits", failure_bits())


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read it, texts are measured once."""
    return materialise(ledger(docs, id_col=id_col, text_col=text_col), "ledger")


def judge(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def filter_documents(docs: DataFrame, policy: str, *, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns they came with."""
    verdict = "__heddle_quality"
    while verdict in docs.columns:
        verdict += "_"
    marked = docs.withColumn(verdict, measure(F.col(text_col)))
    return marked.where(failure_bits(verdict).bitwiseAND(F.lit(mask(policy))) == 0).drop(verdict)


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents failing it, failing only it, and kept without it.

    First one row per distinct bit pattern (at most 2^rules, combined before the shuffle).
    """
    chosen = mask(policy)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if chosen >> i & 1])
    each = patterns.select("bits", "n", F.inline(named))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count(F.col("bits") == F.col("bit")).alias("failed_only"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )
