"""Quality rules as a ledger: each rule is evaluated once and its failure is one
bit beside the measurements. A policy is a versioned set of bits, so a new
policy, or what each rule of it costs, is bit arithmetic over the ledger and
never another look at the texts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_capitals", "longest_word"]


def repeated_words(ids: np.ndarray, distinct: int, window: int = 3) -> int:
    """How many words lie in a window of words that the text has twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, kinds = ids[:n].astype(np.int64), distinct
    for k in range(1, window):
        if kinds * distinct >= 2**62:
            seen, key = np.unique(key, return_inverse=True)
            kinds = len(seen)
        key = key * distinct + ids[k : k + n]
        kinds *= distinct
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : k + n] |= again
    return int(covered.sum())


@lru_cache(1)
def capitals() -> np.ndarray:
    """Whether a code point is an upper-case letter (category Lu)."""
    return np.fromiter((unicodedata.category(chr(k)) == "Lu" for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def measures(text: str) -> tuple[int, ...]:
    """MEASURES of one text. Counting characters here, in C, takes less than built-in
    functions do, each of which makes a copy of the text."""
    words = text.encode().split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    seen, again, filled = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            filled += 1
            if line in seen:
                again += 1
            seen.add(line)
    upper = int(capitals()[np.frombuffer(text.encode("utf-32-le"), "<u4")].sum())
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), again, repeated_words(ids, len(known)),
        filled, text.count("!"), upper, max(map(len, known), default=0),
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds; its place in RULES is its bit."""

    name: str
    fails: Column


def rules(of: Callable[[str], Column] = F.col) -> list[Rule]:
    """The rules in bit order, over the measures that ``of`` gives by name. New
    ones go to the end: old ledgers stay valid."""
    words = of("n_words")
    return [
        Rule("few_words", words < 50),
        Rule("repeated_words", 100 * of("n_repeat_words") > 50 * words),
        Rule("symbols", of("n_symbols") * 10 > words),
        Rule("repeated_lines", of("n_dup_lines") * 2 > of("n_lines")),
        Rule("word_length", (of("word_chars") < 2 * words) | (of("word_chars") > 20 * words)),
        Rule("exclaims", of("n_exclaims") * 5 > words),
        Rule("capitals", of("n_capitals") * 2 > of("word_chars")),
        Rule("many_words", words > 1_000_000),
        Rule("long_word", of("longest_word") > 1_000),
    ]


BITS = {name: 1 << k for k, name in enumerate(["few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "exclaims", "capitals", "many_words", "long_word"])}


@dataclass(frozen=True)
class Policy:
    """A document is dropped when it fails any rule of the policy."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "exclaims")),
        Policy("v2", ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "exclaims", "capitals")),
    )
}


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t or "") for t in texts], columns=MEASURES, dtype="int64")


def failures(of: Callable[[str], Column] = F.col) -> Column:
    """The bits of the rules that fail."""
    failed = F.lit(0).cast("long")
    for r in rules(of):
        failed = failed.bitwiseOR(F.when(r.fails, F.lit(BITS[r.name])).otherwise(F.lit(0)).cast("long"))
    return failed


def ledger(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, MEASURES (LONG) and ``failed``, a LONG of bits.

    A null text is an empty one. Repeated rows give repeated rows; other columns
    of the input play no part.
    """
    rows = docs.select(F.col(id).alias("id"), measured(F.col(text)).alias("m"))
    return rows.select("id", "m.*").withColumn("failed", failures()).withColumnRenamed("id", id)


def passes(policy: Policy, failed: Column | None = None) -> Column:
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def judged(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs``, all columns as they are, each row with its entry of the ledger, a
    struct of MEASURES and ``failed``, as one more column; and that column's name.
    Written once, it serves every policy and ablation without the texts."""
    name = fresh(docs, "measured")
    wide = docs.withColumn(name, measured(F.col(text)))
    of = lambda m: F.col(f"{name}.{m}")
    entry = F.struct(*[of(m).alias(m) for m in MEASURES], failures(of).alias("failed"))
    return wide.withColumn(name, entry), name


def keep_good(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the policy keeps.

    Each row is judged where it lies: nothing is shuffled.
    """
    wide, name = judged(docs, text)
    return wide.where(passes(policy, F.col(f"{name}.failed"))).drop(name)


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: how many rows it fails, how many only it fails
    (they come back without it), and how many the policy keeps with and without it.

    Rows first fall to one count per bit pattern, so what is exploded over the
    rules is bounded by the patterns and not by the rows. An empty ledger gives
    no rows.
    """
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask))
    patterns = ledger.groupBy(masked.alias("pattern")).count()
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules]))
    each = patterns.select("*", rule.alias("r")).select("pattern", "count", "r.rule", "r.bit")
    rest = F.col("pattern").bitwiseAND(F.bitwise_not("bit")) == 0
    total = lambda when: F.sum(F.when(when, F.col("count")).otherwise(0))
    return each.groupBy("rule").agg(
        total(F.col("pattern").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total((F.col("pattern") == F.col("bit"))).alias("n_only"),
        total(F.col("pattern") == 0).alias("n_kept"),
        total(rest).alias("n_kept_without"),
    ).withColumn("policy", F.lit(policy.version))
