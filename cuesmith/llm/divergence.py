"""How far each source's use of words lies from its language's other sources.

Plain relational work: terms are exploded and counted by group, the groups of a
language are crossed with the terms it keeps so that zeros are there, a self-join
on language and term compares two sources, and windows rank the sums. Shares are
whole parts of a billion and all arithmetic is on integers, so results repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

#: What a term is made of: everything but ASCII other than letters (fixed value).
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = ["lang", "source"]
#: Terms of a language, about, that one task crosses with its groups.
TERMS_A_SALT = 50_000


@dataclass(frozen=True)
class Audit:
    """``least_docs``: a language keeps terms of at least so many of its documents;
    ``added``: occurrences that every term gets beyond its own; ``top``: most terms
    reported a group."""

    least_docs: int = 10
    added: int = 2
    parts: int = 1_000_000_000
    top: int = 10


def matches(text: Column) -> Column:
    """The terms of a text in order; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and the
    documents that have it. A document's matches are exploded, and its distinct ones
    beside them, so both counts are of the same pass and meet by (group, term)."""
    words = docs.select(*_named(docs), matches(F.col("text")).alias("words"))
    both = words.select(*GROUP, F.posexplode(F.array("words", F.array_distinct("words"))).alias("once", "words"))
    each = both.select(*GROUP, F.col("once").cast("long").alias("once"), F.explode("words").alias("term"))
    return each.groupBy(*GROUP, "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def _named(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP]


def share(count: Column, total: Column, terms: Column, a: Audit) -> Column:
    """1 + floor(parts * (count + added) / (total + added * terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, under = F.lit(a.parts).cast("decimal(10,0)") * wide(count + a.added), wide(total + a.added * terms)
    return F.lit(1).cast("long") + F.floor(_div(top, under)).cast("long")


def _div(top: Column, under: Column) -> Column:
    return F.call_function("div", top, under)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, a LONG."""
    return _div((p - q) * (p - q), p + q)


def divergence(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group of documents.

    Part ``pair`` has each other source of the language, whose value is the sum of
    ``gap`` over the language's kept terms; part ``term`` the terms that the group uses
    more than its language does, the ``top`` first. Null text, lang and source are
    empty strings. A group without terms is compared all the same; a language that
    keeps no term gives pairs of value 0. Repeated rows are documents of their own.
    An empty table gives no rows; columns other than text, lang and source play no part.

    Terms are counted where they lie first, so partial counts meet by (group, term)
    and a hot source is spread over its terms. Terms are crossed with groups in
    salts of ``TERMS_A_SALT``, so a language with most terms is many tasks.
    """
    counts = stored(term_counts(docs), "terms")
    vocab = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= audit.least_docs).drop("docs")
    vocab = stored(vocab, "vocabulary")
    groups = stored(docs.select(*_named(docs)).distinct(), "groups")

    salts = 1 + vocab.count() // TERMS_A_SALT
    sizes = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("all_total"))
    used = counts.join(vocab.select("lang", "term"), ["lang", "term"], "left_semi").select(*GROUP, "term", "n")
    totals = groups.join(sizes, "lang").join(used.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left")
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    grid = vocab.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(totals, ["lang", "salt"]).drop("salt")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    dense = grid.join(used, [*GROUP, "term"], "left").select(
        *GROUP, "term", zero("n").alias("n"), share(zero("n"), zero("total"), F.col("kept"), audit).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("kept"), audit).alias("q")
    )
    dense = stored(dense, "shares")

    one = dense.select("lang", "term", "source", "p")
    other = one.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy(*GROUP, "item").agg(F.sum(gap(F.col("p"), F.col("q"))).alias("value"))
    both = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    mirrored = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both.join(mirrored, [*GROUP, "item"], "left").select(*GROUP, F.lit("pair").alias("part"), "item", zero("value").alias("value"))

    more = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    terms = more.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    result = stored(pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= audit.top)), "divergence")
    discard(counts, vocab, groups, dense)
    return result
