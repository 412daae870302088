"""Rule ensemble, hard negatives and divergence: odd tables, and plain versions of each."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesmith.llm import divergence as dv
from cuesmith.llm import hard_negatives as hn
from cuesmith.llm import rule_ensemble as re_

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, term string, n long, s string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 1, "x", 1, "x") for r in rows], DOCS)


# divergence


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_audit(rows, least=10, top=10):
    docs = [(r[2] or "", r[3] or "", plain_terms(r[1])) for r in rows]
    df, lang_n, n = Counter(), Counter(), Counter()
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        lang_n.update((lang, t) for t in terms)
        n.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), k in df.items():
        if k >= least:
            kept[lang].append(t)
    groups = {(lang, source) for lang, source, _ in docs}
    share = lambda c, total, v: 1 + (10**9 * (c + 2)) // (total + 2 * v)
    p, q = {}, {}
    for lang, source in groups:
        total = sum(n[lang, source, t] for t in kept[lang])
        p.update({(lang, source, t): share(n[lang, source, t], total, len(kept[lang])) for t in kept[lang]})
    for lang, terms in kept.items():
        total = sum(lang_n[lang, t] for t in terms)
        q.update({(lang, t): share(lang_n[lang, t], total, len(terms)) for t in terms})
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        pairs = [(sum(f(p[lang, source, t], p[lang, o, t]) for t in kept[lang]), o) for x, o in groups if x == lang and o != source]
        terms = [(f(p[lang, source, t], q[lang, t]), t) for t in kept[lang] if n[lang, source, t] and p[lang, source, t] > q[lang, t]]
        for part, got, most in (("pair", pairs, None), ("term", terms, top)):
            for k, (v, item) in enumerate(sorted(got, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, v, k))
    return sorted(out)


def odd_audit_rows():
    r = random.Random(5)
    words = ["alpha", "Beta", "été", "ÉTÉ", "漢字", "𝒳𝒴", "x1y", "don't", "a-b", "Ωmega"]
    rows = [(k, " ".join(r.choices(words, weights=range(1, 11), k=r.randint(0, 30))), r.choice(["en", "fr"]), r.choice(["a", "b", "hot", "hot", "hot"]), 1)[:4] for k in range(120)]
    rows += [(200, None, None, None), (201, "", "en", "only empty"), (202, "alpha " * 50_000, "en", "long"), (203, "few words", "de", "a"), (204, "few", "de", "b"), (None, "alpha beta", "en", "a"), (205, "alpha", "en", ""), (205, "alpha", "en", "")]
    return rows


def test_divergence_against_the_plain_version(spark, monkeypatch):
    rows = odd_audit_rows()
    want = plain_audit(rows)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    for salt in (dv.TERMS_A_SALT, 2):
        monkeypatch.setattr(dv, "TERMS_A_SALT", salt)
        got = dv.divergence(documents(spark, rows).repartition(3)).select(*columns).collect()
        assert sorted(map(tuple, got)) == want
    assert {r[0] for r in want if r[2] == "pair"} >= {"en", "fr", "de"}  # de keeps no term: its pairs have value 0
    assert dict(dv.divergence(documents(spark, rows)).dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_divergence_of_no_rows_and_of_no_terms(spark):
    assert dv.divergence(documents(spark, [])).collect() == []
    got = dv.divergence(documents(spark, [(1, "...", "en", "a"), (2, "1 2", "en", "b")])).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_beyond_64_bits(spark):
    one = spark.createDataFrame([(10**13, 10**15, 7)], "c long, total long, v long")
    assert one.select(dv.share(F.col("c"), F.col("total"), F.col("v"), dv.Audit())).first()[0] == 1 + 10**9 * (10**13 + 2) // (10**15 + 14)


def test_terms_are_counted_by_group_and_by_document(spark):
    texts = ["b a B", "", None, "...", "éÉ é", "a" * 100_000 + " a a", "a a a", "a a a"]
    got = dv.term_counts(documents(spark, [(k, x, "en", "s") for k, x in enumerate(texts)])).collect()
    n, docs = Counter(), Counter()
    for x in texts:
        n.update(plain_terms(x))
        docs.update(set(plain_terms(x)))
    assert {r["term"]: (r["n"], r["docs"]) for r in got} == {t: (n[t], docs[t]) for t in n}


# hard negatives


def plain_mine(rows, every=100, pos=5, neg=5, low=80, high=100, scale=256):
    ok = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        ok.append((i, label, [int(np.floor(scale * float(x))) for x in v]))
    out = []
    for ai, al, av in ok:
        if ai % every:
            continue
        scored = [(-sum(a * b for a, b in zip(av, v, strict=True)), i, label) for i, label, v in ok if len(v) == len(av)]
        for ps, pi, _ in sorted(x for x in scored if x[2] == al and x[1] != ai)[:pos]:
            fit = sorted(x for x in scored if x[2] != al and low * -ps <= 100 * -x[0] <= high * -ps)[:neg]
            out += [(ai, pi, k, ni, -ps, -ns) for k, (ns, ni, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, anchor=None, **how):
    df = spark.createDataFrame(rows, "id long, label int, vector array<float>").withColumns({c: F.lit("x") for c in ("block", "dim", "kind", "asked", "score")})
    got = hn.mine(df.repartition(3), F.col("id") % 100 == 0 if anchor is None else anchor, hn.Mining(**how))
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def vectors(seed, n, dim=6, labels=3):
    r = np.random.default_rng(seed)
    return [(k * 10, int(r.integers(labels)), [float(x) for x in r.normal(0, 0.5, dim).astype(np.float32)]) for k in range(n)]


@pytest.mark.parametrize("few", [1, 64])
def test_negatives_against_the_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(hn, "FEW", few)  # 1: digits are refined to the last
    monkeypatch.setattr(hn, "BLOCK_ROWS", 100)
    rows = vectors(1, 300)
    want = plain_mine(rows)
    assert want and mined(spark, rows) == want


def test_ties_repeats_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(hn, "FEW", 4)
    rows = vectors(2, 60)
    rows += [(1000 + k, 1 + k % 2, [0.5] * 6) for k in range(150)]  # one vector of many rows: the ids decide
    rows += [(-(2**63), 1, [0.5] * 6), (2**63 - 1, 2, [0.5] * 6), (1100, 1, [0.5] * 6), (1100, 1, [0.5] * 6)]
    rows += [(None, 1, [0.5] * 6), (5, None, [0.5] * 6), (6, 1, None), (7, 1, [0.5] * 5 + [None]), (8, 2, [float("nan")] + [0.5] * 5), (9, 2, [float("-inf")] + [0.5] * 5)]
    rows += [(2000, 1, []), (2001, 1, []), (2002, 2, []), (3000, 1, [1.0, 2.0]), (3001, 1, [1.0, 2.0]), (3002, 2, [1.0, 1.75]), (3003, 2, [-1.0, -2.0])]
    want = plain_mine(rows)
    assert any(w[0] == 2000 for w in want) and any(w[0] == 3000 for w in want)
    assert mined(spark, rows) == want


def test_large_components_are_exact(spark):
    rows = [(k, k % 2, [float(np.float32(2.0**20 + 3 * k)), float(np.float32(2.0**21 - k))]) for k in range(40)]
    want = plain_mine(rows, every=20)
    assert want and mined(spark, rows, F.col("id") % 20 == 0) == want
    far = [(k, k % 2, [3e38, 1.0]) for k in range(4)]  # sums beyond 64 bits all count as the same
    assert {r[4] for r in mined(spark, far)} == {hn.FAR}


def test_negatives_of_empty_and_lonely_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (101, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (101, 2, [1.0])]) == []


# rule ensemble


def plain_holds(rule, row):
    return all((row[name] > at) if above else (row[name] <= at) for name, above, at in rule)


def quality_rows(n=400):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.3
        kind = r.randint(0, 2)
        if bad:
            words = [w + "***" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:3] * 30
        docs.append((k, " ".join(words), "en", "a"))
        labels.append((k, int(not bad), 0))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = quality_rows()
    odd = [(None, "no id", "en", "a"), (1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "x" * 300_000, "en", "a"), (1003, "word " * 50_000, "en", "a"), (3, "a second text of an id", "en", "a")]
    labels += [(None, 1, 0), (5000, 1, 0), (1, None, 0), (2, 1, 0), (2, 0, 0)]
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, odd, labels, re_.score_quality(documents(spark, docs + odd), marks, ~held).collect()


def test_held_out_documents_are_told_apart(scored):
    docs, odd, labels, got = scored
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    label = {k: q for k, q, _ in labels[: len(docs)]}
    held = [(r["score"], label[r["doc_id"]]) for r in got if r["doc_id"] in label and r["doc_id"] not in (1, 2, 3) and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(held) > 50 and auc > 0.97


def test_compiled_rules_are_the_rules(spark):
    docs, labels = quality_rows(200)
    label = {k: q for k, q, _ in labels}
    seen = documents(spark, docs).select(F.col("doc_id").alias("id"), re_.statistics(F.col("text")).alias("s")).select("id", "s.*")
    marks = spark.createDataFrame(list(label.items()), "id long, label int")
    model = re_.fit(seen.join(marks, "id"))
    assert 0 < len(model.rules) <= 96 and len(model.described()) == len(model.rules)
    for r in seen.withColumn("score", model.score()).collect():
        total = model.intercept + sum(w for rule, w in model.rules if plain_holds(rule, r.asDict()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
        assert tuple(r[c] for c in re_.STATISTICS) == re_.statistics_of(docs[r["id"]][1])


def test_tree_paths():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=3
  If (feature 0 <= 1.5)
   If (feature 0 <= -0.25)
    Predict: 1.0
   Else (feature 0 > -0.25)
    Predict: 0.0
  Else (feature 0 > 1.5)
   Predict: 1.0
"""
    low, mid, high = (("a", False, 1.5),), (("a", False, 1.5), ("a", True, -0.25)), (("a", True, 1.5),)
    paths = re_.tree_paths(tree, ["a", "b", "c"])
    assert paths == [low, (("a", False, -0.25),), mid, high]
    assert re_.candidates([tree.replace("feature 0", "feature 1")]) == [(("mean_word", False, -0.25),), (("mean_word", False, 1.5), ("mean_word", True, -0.25)), (("mean_word", True, 1.5),)]


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "one text", "en", "a"), (2, None, "en", "a")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in re_.score_quality(docs, none, F.lit(True)).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r["score"] for r in re_.score_quality(docs, ones, F.lit(True)).collect()] == pytest.approx([0.75, 0.75])
    assert re_.score_quality(docs.where("false"), ones, F.lit(True)).collect() == []
