"""The pipeline, stage by stage, against plain versions; and on odd tables."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from cuesmith.llm import common, quality
from tests.llm.test_operators import DOCS, odd_rows, plain_components, plain_measures, plain_targets

SMALL = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, stage in cp.STAGES[:-1]:
        out.append(stage(spark, out[-1], sf_dir).cache())
        assert out[-1].columns == docs.columns
    return [list(df.collect()) for df in out], list(cp.STAGES[-1][1](spark, out[-1], sf_dir).collect())


def check(docs, pieces):
    start, good, single, apart, mixed = docs
    for r in start:
        n, _, symbols, _, again = plain_measures(r.text)
        if n < 50 or 100 * again > 50 * n or symbols * 10 > n:
            assert r not in good
    assert all(plain_measures(r.text)[0] >= 50 for r in good)
    best = defaultdict(list)
    for r in good:
        best[r.text].append(r.doc_id)
    assert Counter(r.text for r in single) == Counter(best.keys()) and all(r.doc_id == max(best[r.text]) for r in single)
    comps = plain_components([(r.doc_id, r.text) for r in single], 5)
    assert {r.doc_id for r in apart} == {c for _, c in comps.values()}
    size = {r.doc_id: len((r.text or "").encode().split()) for r in apart}
    took = Counter(r.doc_id for r in mixed)
    assert set(took) <= set(size) and max(took.values(), default=0) <= 2
    by = defaultdict(list)
    for r in apart:
        by[r.source].append(r.doc_id)
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    goal = plain_targets([sum(size[i] for i in by[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    for s, want in zip(names, goal, strict=True):
        assert abs(sum(took[i] * size[i] for i in by[s]) - want) <= max(size[i] for i in by[s])
    held = Counter()
    for p in pieces:
        held[(p.doc_id, p.copy)] += p.length
    assert held == {(i, k): size[i] + 1 for i, n in took.items() for k in range(n)}


def test_stages_on_the_smallest_tables(spark):
    docs, pieces = stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    check(docs, pieces)
    assert len(docs[0]) > len(docs[1]) > len(docs[2]) > len(docs[3]) > 0 and len(docs[4]) > len(docs[3])


def test_run_is_the_stages(spark):
    _, pieces = stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    before = set(common.WRITTEN)
    got = cp.run(spark, SMALL)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common.WRITTEN if p not in before]
    assert left == ["source_mix"]  # what the last stage reads
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pieces))


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS digest", "'x' AS _shard2", "2 AS size").write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    assert bool(got) == bool(rows)


def test_clean_documents_stay(spark):
    """Of the documents labelled good and long enough, the rules drop none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id"), "doc_id")
    ledger = quality.ledger(docs).where(quality.passes(quality.BASE))
    assert ledger.count() == ledger.where(quality.passes(quality.POLICIES["v1"])).count() > 200


def test_exact_copies_leave_one_row_of_each_text(spark):
    """Repeated rows of an id, and copies without any id, are copies too."""
    rows = [(1, "a"), (7, "a"), (7, "a"), (None, "a"), (None, "b"), (None, "b"), (7, "c"), (3, "d"), (3, "d"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, x, "s") for i, x in rows], "doc_id long, text string, source string").repartition(3)
    got = cp.exact_copies(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted((r.text or "", r.doc_id) for r in got.where("doc_id is not null").collect()) == [("", 4), ("a", 7), ("c", 7), ("d", 3)]
    assert [r.text for r in got.where("doc_id is null").collect()] == ["b"]
