"""URL allow and block lists: a broadcast trie of reversed host labels and path
segments, longest match first.

A rule is an action, a host and a path. It fits its host and every subdomain
when the path of the URL starts with its own. Of the rules that fit, the one
with the most characters wins; at equal length the longer host, then block.
Lists beyond ``max_broadcast`` rules are joined instead, with the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple:
        return len(self.text), len(self.host), self.action == "block"


@dataclass
class Node:
    """One step of the trie; ``paths`` starts the path part, ``ends`` maps the
    last, possibly partial, segment of a rule's path to the rule."""

    kids: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    ends: dict[str, Rule] = field(default_factory=dict)


def build_trie(rules: Sequence[Rule]) -> Node:
    root = Node()
    for r in rules:
        node = root
        for label in reversed(r.host.split(".")):
            node = node.kids.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *whole, last = r.path.split("/")
        for segment in whole:
            node = node.kids.setdefault(segment, Node())
        old = node.ends.get(last)
        if old is None or r.rank > old.rank:
            node.ends[last] = r
    return root


def best_rule(root: Node, host: str, path: str) -> Rule | None:
    best: Rule | None = None
    node, segments = root, path.split("/")
    for label in reversed(host.split(".")):
        node = node.kids.get(label)
        if node is None:
            break
        at = node.paths
        for segment in segments:
            if at is None:
                break
            for last, r in at.ends.items() if len(at.ends) <= len(segment) + 1 else ((segment[:k], at.ends[segment[:k]]) for k in range(len(segment) + 1) if segment[:k] in at.ends):
                if segment.startswith(last) and (best is None or r.rank > best.rank):
                    best = r
            at = at.kids.get(segment)
    return best


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_broadcast: int = 1_000_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict added.

    ``rule`` is null and ``verdict`` is ``default`` where no rule fits. A null
    or unparsable URL has empty host and path and fits none. Columns of these
    four names in the input are replaced; rows are never dropped or merged.
    """
    parsed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    judged = fresh(parsed, "judged")
    if len(rules) > max_broadcast:
        return judge_by_join(parsed, pages.sparkSession.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            found = [best_rule(root, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r and r.text for r in found], "verdict": [r.action if r else default for r in found]})

    return parsed.withColumn(judged, verdicts("host", "path")).withColumns({"rule": F.col(f"{judged}.rule"), "verdict": F.col(f"{judged}.verdict")}).drop(judged)


def judge_by_join(parsed: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same verdicts for a rule table of any size, by an equi join.

    Every distinct (host, path) offers its host suffixes and its path up to each
    slash; a rule waits at its host and its path up to the last slash. Distinct
    pairs keep a hot host from multiplying the candidates.
    """
    hosts = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.split("path", "/", -1)
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    offers = hosts.select("host", "path", F.explode(suffixes).alias("_at")).select("*", F.explode(folders).alias("_folder"))
    waiting = rules.select("action", F.col("host").alias("_at"), F.col("path").alias("_path"), F.regexp_extract("path", r"^(.*/)?", 1).alias("_folder"))
    rank = F.struct(F.length("_at") + F.length("_path"), F.length("_at"), (F.col("action") == "block").cast("int"))
    best = offers.join(waiting, ["_at", "_folder"]).where(F.startswith("path", "_path")).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_at", "_path").alias("rule"), "action"), rank).alias("_best"))
    name = fresh(parsed, "best")
    return parsed.join(best.withColumnRenamed("_best", name), ["host", "path"], "left").withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.coalesce(f"{name}.action", F.lit(default))}).drop(name)
