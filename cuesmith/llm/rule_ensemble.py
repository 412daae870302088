"""A quality classifier of sparse conjunctive rules.

Shallow trees are grown over statistics of texts; each path from a root is a rule, a
conjunction of thresholds. A logistic model with an absolute penalty weighs the rules
and leaves few; what is left is compiled into one Column expression, so scoring is a
projection over the statistics and needs no model in the workers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality
from .common import discard, stored

#: The statistics of a text, all of its whole text; shares are 0 where there is nothing to share.
STATISTICS = [
    "words", "mean_word", "longest_word", "distinct_share", "top_share", "repeat_share", "line_share", "words_a_line",
    "symbol_rate", "exclaim_rate", "mark_rate", "capital_share", "digit_share", "run_share",
]
#: Marks of prose, and of tables and emphasis (fixed values).
MARKS = ".,;:?"


def statistics_of(text: str) -> tuple[float, ...]:
    n_words, chars, symbols, again, repeated, filled, exclaims, upper, longest = quality.measures(text)
    share = lambda part, whole: part / whole if whole else 0.0
    words = text.encode().split()
    counts = Counter(words)
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    digits = sum(map(text.count, "0123456789"))
    return (
        float(n_words), share(chars, n_words), float(longest), share(len(counts), n_words), share(max(counts.values(), default=0), n_words), share(repeated, n_words), share(again, filled),
        share(n_words, filled), share(symbols, n_words), share(exclaims, n_words), share(sum(map(text.count, MARKS)), n_words), share(upper, chars), share(digits, chars), share(runs, n_words),
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in STATISTICS]))
def statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics_of(t or "") for t in texts], columns=STATISTICS, dtype="float64")


@dataclass(frozen=True)
class Fit:
    """How rules are found and weighed (documented bounds).

    ``most_rows``: labelled rows, at most, that the model is fitted to, those of the
    lowest hash of id and text statistics; ``trees`` of ``depth`` give the paths;
    a rule holds for ``least_share`` to ``1 - least_share`` of the rows, ``most_rules`` of
    the best balanced are weighed; ``penalty`` is the lasso's.
    """

    most_rows: int = 60_000
    trees: int = 24
    depth: int = 3
    least_share: float = 0.002
    most_rules: int = 96
    penalty: float = 0.0005
    rounds: int = 40
    seed: int = 11


#: One threshold: (statistic, whether above it, threshold).
Condition = tuple[str, bool, float]
RuleKey = tuple[Condition, ...]


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights and the intercept."""

    rules: tuple[tuple[RuleKey, float], ...]
    intercept: float

    def score(self, of: Callable[[str], Column] = F.col) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = reduce(lambda sum, rule: sum + F.when(holds(rule[0], of), F.lit(rule[1])).otherwise(F.lit(0.0)), self.rules, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def described(self) -> list[str]:
        """The rules in words, the heaviest first."""
        say = lambda c: f"{c[0]} {'>' if c[1] else '<='} {c[2]:.6g}"
        return [f"{w:+.4f} if " + " and ".join(map(say, r)) for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def holds(rule: RuleKey, of: Callable[[str], Column] = F.col) -> Column:
    return reduce(Column.__and__, [(of(name) > at) if above else (of(name) <= at) for name, above, at in rule])


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def tree_paths(tree: str, names: list[str] = STATISTICS) -> list[RuleKey]:
    """The conjunctions on the way to each node but the root, of a tree as Spark prints
    it; of thresholds on one statistic and side the tightest stays."""
    open_, found = [], []
    for line in tree.splitlines():
        m = _BRANCH.match(line)
        if not m:
            continue
        depth, name, above, at = len(m[1]), names[int(m[2])], m[3] == ">", float(m[4])
        open_ = [x for x in open_ if x[0] < depth] + [(depth, (name, above, at))]
        tight: dict[tuple[str, bool], float] = {}
        for _, (n, up, t) in open_:
            tight[n, up] = max(tight.get((n, up), t), t) if up else min(tight.get((n, up), t), t)
        found.append(tuple(sorted((n, up, t) for (n, up), t in tight.items())))
    return found


def candidates(forest: list[str]) -> list[RuleKey]:
    """Distinct rules of a forest; of a single threshold and its opposite the upper side."""
    rules = dict.fromkeys(r for tree in forest for r in tree_paths(tree))
    return [r for r in rules if len(r) > 1 or r[0][1] or ((r[0][0], True, r[0][2]),) not in rules]


def fit(rows: DataFrame, how: Fit = Fit()) -> Ensemble:
    """The ensemble of ``rows`` with STATISTICS and ``label`` 0 or 1.

    Without rows of both labels there is no rule and the score is the share of
    label 1, one row of each added. More than ``most_rows`` rows are sampled by hash.
    """
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = by_label.get(0, 0), by_label.get(1, 0)
    nothing = Ensemble((), float(np.log((good + 1) / (bad + 1))))
    if not bad or not good:
        return nothing
    hashed = F.pmod(F.xxhash64("id", *STATISTICS), F.lit(1_000_000))
    some = rows.withColumn("_hash", hashed).where(F.col("_hash") < F.lit(how.most_rows / (bad + good) * 1_000_000))
    some = stored(some.select(F.col("label").cast("double").alias("label"), *STATISTICS).repartition(8, *STATISTICS).sortWithinPartitions(*STATISTICS, "label"), "labelled")
    if some.select("label").distinct().count() < 2:
        discard(some)
        return nothing
    vectors = some.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=how.seed, maxBins=64).fit(vectors)
    rules = candidates([t.toDebugString for t in forest.trees])
    rows_n = some.count()
    held = some.agg(*[F.sum(holds(r).cast("int")).alias(str(k)) for k, r in enumerate(rules)]).first() if rules else []
    fair = lambda k: min(held[k], rows_n - held[k]) / rows_n
    rules = [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-fair(k), rules[k])) if fair(k) >= how.least_share][: how.most_rules]
    if not rules:
        discard(some)
        return nothing
    ones = some.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=how.penalty, maxIter=how.rounds).fit(ones)
    weights = model.coefficients.toArray()
    discard(some)
    return Ensemble(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(model.intercept))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, how: Fit = Fit(), good: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, by an ensemble fitted to its
    labelled rows where ``learn``, over the id, holds.

    A null text is an empty one. Labels join by id: a row whose id has several labels
    stands in the fit with each, rows without id or with a null label in none, and an
    id that repeats is scored row by row. Statistics of texts are the only inputs.
    Empty tables give no rows; without labels all scores are one half.
    """
    seen = stored(docs.select(F.col("doc_id").alias("id"), statistics(F.col("text")).alias("s")).select("id", "s.*"), "statistics")
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1)).distinct()
    learned = fit(seen.where(learn).join(marks, "id"), how)
    rows = seen.select(F.col("id").alias("doc_id"), learned.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= good).cast("int"))
