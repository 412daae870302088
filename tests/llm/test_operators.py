"""Each operator on odd tables, and against a plain version of itself."""

import gzip
import hashlib
import json
import math
import random
import re
import struct
import time
import unicodedata
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesmith.llm import class_lm, common, exact_dedup, files, graph, mixing, near_dedup, packing, personal_data, quality, token_ids, url_filter, web_archive

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use inside.
CLASH = ["id", "n", "key", "digest", "run", "component", "kept", "_lost", "_measured", "row", "at", "takes", "_block", "size", "tokens", "grp", "print", "registers", "_judged", "band"]

rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def odd_rows():
    long = prose(30_000, 1)
    rows = [(0, None, None, None, None), (1, "", "en", "b", 0), (2, " \t\n", "en", "b", 3), (3, "one", "en", "a", 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "no id here", "en", None, 1), (None, None, None, None, None)]
    rows += [(5, long, "en", "a", 1), (6, long, "en", "a", 1), (7, "x" * 200_000, "en", "c", 1), (8, long.replace(" ", "  ", 50), "en", "c", 1)]
    rows += [(10 + k, prose(80, k), "en", ["a", "b", "c"][k % 3], 1) for k in range(20)]
    rows += [(40 + k, prose(80, 7) + f" tail{k}", "fr", "d", 1) for k in range(10)]
    rows += [(60 + k, "same text again and again", "fr", "hot", 1) for k in range(30)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(5)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def by_id(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


# quality rules


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(grams)
    repeated = {k + i for k, g in enumerate(grams) if many[g] > 1 for i in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_measures_of_odd_texts(spark):
    texts = [None, "", "a", "a a a a", "a b c a b c x", "q\nq\n\nq\x1c r\u2028\u3000s", "a b a b a b", "# *x&|<>%$", prose(3000, 2), "x" * 100_000, "é\u00a0b\x85c d\u00a0e", "ÀB c! ǅ Ⅷ ΣΑ!! \U00010400 😀"]
    rows = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert tuple(r[m] for m in quality.MEASURES[:5]) == plain_measures(text), text
        assert r.n_exclaims == text.count("!") and r.n_capitals == sum(unicodedata.category(c) == "Lu" for c in text)
        assert r.longest_word == max(map(len, text.encode().split()), default=0)


def test_repeated_words_with_large_vocabularies():
    ids = np.array([0, 1, 2, 9, 0, 1, 2, 8, 7])
    assert quality.repeated_words(ids, 2**31) == quality.repeated_words(ids, 10) == 6


def test_ledger(odd, none):
    got = quality.ledger(odd).collect()
    assert by_id(got, "doc_id", *quality.MEASURES[:5]) == sorted(((r[0], *plain_measures(r[1])) for r in odd_rows()), key=repr)
    assert quality.ledger(none).count() == 0
    assert quality.ablations(quality.ledger(none), quality.POLICIES["v1"]).count() == 0


def test_bits_and_rules_agree(spark):
    assert [r.name for r in quality.rules()] == list(quality.BITS)
    assert sum(quality.BITS.values()) == 2 ** len(quality.BITS) - 1


def test_ablations(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "failed long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) for r in quality.ablations(rows, quality.POLICIES["v1"]).collect()}
    assert got["few_words"] == (3, 2, 2, 4) and got["repeated_words"] == (1, 0, 2, 2) and got["symbols"] == (1, 1, 2, 3)


def test_keep_good_is_the_ledgers_verdict(odd):
    policy = quality.POLICIES["v1"]
    kept = quality.keep_good(odd, policy)
    assert kept.columns == odd.columns
    assert kept.count() == quality.ledger(odd).where(quality.passes(policy)).count() > 0


# exact copies


def test_exact_groups(odd, none):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[r[1] or ""].append(r[0])
    for keep, pick in (("largest", max), ("smallest", min)):
        want = []
        for text, ids in groups.items():
            best = pick((i for i in ids if i is not None), default=None)
            want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        assert by_id(exact_dedup.exact_groups(odd, keep=keep).collect(), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_groups(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(odd, keep="any")


@pytest.mark.parametrize(("runs", "bits"), [(1, 1), (2, 1), (7, 1), (64, 2), (4096, 6)])
def test_tree_shape_does_not_matter(odd, runs, bits):
    prints = exact_dedup.fingerprints(odd)
    got = exact_dedup.merge_runs(prints, runs=runs, bits=bits).collect()
    assert by_id(got, "digest", "keep_id", "group_size") == by_id(exact_dedup.merge_runs(prints).collect(), "digest", "keep_id", "group_size")


def test_drop_copies(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = Counter((r.text or "") for r in kept.collect())
    assert set(texts) == {r[1] or "" for r in odd_rows()} and texts["same text again and again"] == 1
    assert exact_dedup.drop_copies(none).count() == 0


# near copies


def plain_components(rows, words, percent=80):
    sets = {i: near_dedup.shingles(near_dedup.words_of(t), words) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and near_dedup.similar(sets[a], sets[b], percent):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups(odd, none, words):
    want = plain_components([(r[0], r[1]) for r in odd_rows()], words)
    got = near_dedup.near_groups(odd, near_dedup.Sketch(words=words)).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_groups(none).count() == 0


def test_chains_and_blocks(spark, monkeypatch):
    """A drifting chain of texts: neighbours link, ends do not; blocks of two."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    base = prose(120, 11).split()
    rows = []
    for k in range(40):
        base = base[2:] + [f"w{k}a", f"w{k}b"]
        rows.append((100 - k if k % 2 else k, " ".join(base)))
    rows += [(200 + k, prose(120, 50 + k)) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df, near_dedup.Sketch(words=2)).collect()}
    assert got == want and len({c for _, c in want.values()}) < 30


def test_registers_merge_and_estimate():
    sketch = near_dedup.Sketch(words=1, bands=100, rows=5)
    seeds = near_dedup.seeds_of(sketch)
    r = np.random.default_rng(4)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    ra, rb = near_dedup.registers(a, sketch, seeds), near_dedup.registers(b, sketch, seeds)
    assert (near_dedup.registers(pool, sketch, seeds) == np.maximum(ra, rb)).all()
    counts = [np.array([x]) for x in ((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum())]
    at = lambda j: bool(near_dedup.likely(*counts, np.array([2000.0]), np.array([2000.0]), j, sketch.base)[0])
    assert at(0.2) and not at(0.5)  # the truth is a third


def test_components(spark):
    r = random.Random(8)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)]
    top = {x: x for e in links for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}


def test_drop_near_copies(odd, none):
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {None, 0, 1, 3, 5} <= ids and not {4, 6} & ids and len(ids & set(range(40, 50))) <= 1
    assert near_dedup.drop_near_copies(none).count() == 0


PAIRS = {"A": prose(90, 501), "B": prose(90, 502)}


def keyed(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(parts)


def test_ids_with_several_texts_lose_none(spark):
    rows = [(i, PAIRS[x]) for i, x in ((3, "A"), (5, "A"), (5, "B"), (9, "B"))]
    got = near_dedup.near_groups(keyed(spark, rows), near_dedup.Sketch(words=2)).collect()
    assert by_id(got, "doc_id", "component_id", "kept") == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]
    left = near_dedup.drop_near_copies(keyed(spark, rows))
    assert by_id(left.collect(), "doc_id", "text") == sorted([(3, PAIRS["A"]), (5, PAIRS["B"])])
    assert by_id(exact_dedup.drop_copies(keyed(spark, rows)).collect(), "doc_id", "text") == sorted([(5, PAIRS["A"]), (9, PAIRS["B"])])


def test_one_id_with_two_near_texts(spark):
    near = PAIRS["A"] + " tail"
    got = near_dedup.drop_near_copies(keyed(spark, [(1, PAIRS["A"]), (1, near), (2, near)])).collect()
    assert len(got) == 1 and got[0].doc_id == 1


def test_repeated_rows_and_rows_without_id_leave_one(spark):
    near = PAIRS["B"] + " tail"
    rows = [(1, PAIRS["A"])] * 2 + [(2, PAIRS["B"])] * 3 + [(None, near)] * 2 + [(None, prose(90, 503))] * 3 + [(None, prose(90, 503) + " x")] + [(4, None), (4, None)]
    for drop, texts in ((exact_dedup.drop_copies, 6), (near_dedup.drop_near_copies, 3)):
        got = drop(keyed(spark, rows)).collect()
        full = [r for r in got if r.text]
        assert len(full) == len({r.text for r in full}) == (texts - 1 if drop is exact_dedup.drop_copies else texts)
        assert {r.doc_id for r in full} >= {1, 2}
    twice = spark.read.parquet(f"{SMALL}/documents.parquet")
    twice = twice.union(twice)
    once = exact_dedup.drop_copies(twice)
    assert once.count() == once.select(F.coalesce("text", F.lit(""))).distinct().count() == twice.select(F.coalesce("text", F.lit(""))).distinct().count()
    apart = near_dedup.drop_near_copies(twice.where("text rlike '[a-z]'"))
    assert apart.count() == apart.select("doc_id").distinct().count() == near_dedup.near_groups(twice.where("text rlike '[a-z]'")).select("component_id").distinct().count()


def test_equal_prints_are_confirmed_on_sets(spark, monkeypatch):
    """Rows whose prints agree by accident do not become one class."""
    plain = near_dedup.sketched

    def clash(*args, **kw):
        return plain(*args, **kw).withColumn("print", F.when(F.col("n") > 0, F.lit(b"same"))).withColumn("n", F.when(F.col("n") > 0, F.lit(80)).otherwise(F.col("n")))

    monkeypatch.setattr(near_dedup, "sketched", clash)
    rows = [(k, prose(81, 700 + k)) for k in range(6)] + [(10 + k, prose(81, 700 + k).upper()) for k in range(3)]
    got = near_dedup.near_groups(keyed(spark, rows), near_dedup.Sketch(words=2)).collect()
    assert all(r.kept for r in got if r.doc_id < 10)
    assert {r.component_id for r in got if r.doc_id < 10} == set(range(6))


def test_sets_are_counted_by_their_words():
    for size in (1, 2, 5):
        for text in ("", "a", "a b", "a b a b a b a b", prose(3000, 5), prose(40, 6) * 9):
            words = near_dedup.words_of(text)
            assert len(near_dedup.shingle_hashes(words, size, {})) == len(near_dedup.shingles(words, size))


def hot_bucket(members, outsiders):
    """Unrelated texts that all share one band's registers, in two components."""
    rows = [(0, 77, k, 0 if k < members else k) for k in range(members + outsiders)]
    return rows


def test_a_hot_bucket_moves_no_texts_of_unlikely_pairs(spark):
    sketch = near_dedup.Sketch(words=2)
    rows = hot_bucket(700, 900)
    shared = spark.createDataFrame([(k, band, key, 0) for band, key, k, _ in rows], "node long, band int, key long, hub long")
    shared = shared.union(shared.withColumn("band", F.lit(3)))  # the same members again in a later band
    labels = spark.createDataFrame([(k, c) for _, _, k, c in rows], "node long, component long")
    seeds = near_dedup.seeds_of(sketch)
    r = np.random.default_rng(9)
    regs = [near_dedup.registers(r.integers(0, 2**63, 120).astype(np.uint64), sketch, seeds) for _ in rows]
    regs[1500] = regs[5]  # one likely pair across the components
    classes = spark.createDataFrame([(k, 120, bytearray(x.tobytes())) for k, x in enumerate(regs)], "node long, n long, registers binary")
    blocks = near_dedup.bucket_blocks(shared, labels)
    assert blocks.select("band").distinct().count() == 1  # equal buckets are looked at once
    assert blocks.groupBy(*near_dedup.PAIR).count().agg(F.max("count")).first()[0] < 4 * near_dedup.BLOCK
    wanted = near_dedup.wanted_blocks(blocks, classes, sketch)
    assert {x.node for x in wanted.collect()} == {5, 1500} and wanted.count() == 2


def test_rows_of_one_hubs_buckets_do_not_multiply(spark):
    """A group that meets in twenty bands, each time with nearly the same members, is one
    group: its rows, and four times as many, grow with less than the square."""
    made = []
    for size in (1000, 4000):
        shared = spark.range(size).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("band")).where("node = 0 or (node + band) % 40 > 0")
        shared = shared.select("node", "band", (F.col("band") + 1000).cast("long").alias("key"), F.lit(0).cast("long").alias("hub"))
        labels = spark.range(size // 10).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
        blocks = near_dedup.bucket_blocks(shared, labels)
        assert [tuple(r) for r in blocks.select("key", "band").distinct().collect()] == [(0, -1)]
        assert blocks.select("node").distinct().count() == size
        made.append(blocks.count())
    assert made[0] < 5 * 1000 and made[1] < 8 * made[0]


def test_a_group_below_the_threshold_loses_no_link(spark, monkeypatch):
    """Copies of one text with three to eight changed words, most of them apart; groups of a hub and blocks of them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r = random.Random(77)
    base = prose(110, 900).split()
    texts = []
    for k in range(90):
        words = base.copy() if k % 3 or not k else texts[r.randrange(k)].split()
        for at in r.sample(range(len(words)), r.randint(1, 2) if not k % 3 else r.randint(2, 6)):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    rows = [(1000 + k * 37 % 90, t) for k, t in enumerate(texts)]
    merged, plain = [], near_dedup.bucket_blocks

    def seen(*args):
        blocks = plain(*args)
        merged.append(blocks.where("band < 0").count())
        return blocks

    monkeypatch.setattr(near_dedup, "bucket_blocks", seen)
    want = plain_components(rows, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and merged[0] > 0 and 10 < len({c for _, c in want.values()}) < 85


# class n-grams


def test_scores(odd, none):
    model = class_lm.Model(classes=8, endings=32, lookup=100, rounds=3, flush=200, part_pairs=5000)
    rows = [(r[0], class_lm.tokens_of(r[1]) + [class_lm.END]) for r in odd_rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in rows), key=repr)
    got = class_lm.score_corpus(odd, model).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert class_lm.score_corpus(none, model).count() == 0


def test_scores_by_hand(spark, monkeypatch):
    """Transitions, emissions and unseen words from their definitions, word by word."""
    model = class_lm.Model(classes=6, endings=16, lookup=40, rounds=4, part_pairs=700)
    docs = [(k, prose(30 + k % 50, 900 + k % 37) + (f" new{k}" if k % 9 == 0 else "")) for k in range(200)]
    seen, plain = {}, class_lm.cluster

    def kept(table, n_units, m):
        seen["classes"], seen["n"] = plain(table, n_units, m)
        return seen["classes"], seen["n"]

    rare_words = class_lm.rare_words

    def kept_rare(*args):
        table = rare_words(*args)
        seen["rare"] = {bytes(r.word): (r.n, r.own, r["class"]) for r in table.collect()}
        return table

    monkeypatch.setattr(class_lm, "cluster", kept)
    monkeypatch.setattr(class_lm, "rare_words", kept_rare)
    got = {r.doc_id: r.score for r in class_lm.score_corpus(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), model).collect()}
    texts = {i: [*class_lm.tokens_of(t), b""] for i, t in docs}
    train = {i: w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    count = Counter(w for ws in train.values() for w in ws)
    words = count.most_common()
    once, two = (sum(v == k for v in count.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * two))) if once else 0.5
    bins = Counter(math.floor(math.log2(v) * 16) for w, v in words if w)
    held, least = 0, None
    for b in sorted(bins, reverse=True):
        held += bins[b]
        if held > model.lookup:
            break
        least = min(v for w, v in words if w and math.floor(math.log2(v) * 16) == b)
    top = [w for w, _ in sorted(((w, v) for w, v in words if w and v >= least), key=lambda x: (-x[1], x[0]))]
    unit = {b"": 0, **{w: k + 1 for k, w in enumerate(top)}}
    start_of = lambda w: int(seen["classes"][unit[w] if w in unit else class_lm.ending_unit(w, len(top), model)])
    assert {w: v[0] for w, v in seen["rare"].items()} == {w: k for w, k in count.items() if w not in unit}
    assert all(v[1] == start_of(w) for w, v in seen["rare"].items())
    joined = Counter((a, b) for ws in train.values() for a, b in zip([b"", *ws[:-1]], ws, strict=True))

    def transitions(class_of):
        n = np.zeros((model.classes, model.classes))
        for (a, b), k in joined.items():
            n[class_of(a), class_of(b)] += k
        return n

    assert (transitions(start_of) == seen["n"]).all()
    class_of = lambda w: seen["rare"][w][2] if w in seen["rare"] else start_of(w)
    assert class_lm.likelihood(transitions(class_of)) > class_lm.likelihood(seen["n"])
    pairs = {(a, b): k for (a, b), k in np.ndenumerate(transitions(class_of))}
    size, kinds = Counter(), Counter(class_of(w) for w in count if w)
    for (_, b), k in pairs.items():
        size[b] += k
    total, row = sum(size.values()), Counter()
    for (a, _), k in pairs.items():
        row[a] += k

    def step(a, b):
        x, y = class_of(a), class_of(b)
        p = (pairs[x, y] + model.prior * max(size[y] / total, 1e-12)) / (row[x] + model.prior)
        if b:
            p *= (count[b] - d if b in count else d * max(kinds[y], 1)) / max(size[y], 1)
        return math.log10(p)

    for i, ws in texts.items():
        want = sum(step(a, b) for a, b in zip([b"", *ws[:-1]], ws, strict=True))
        assert abs(got[i] - want) < 1e-6 * abs(want), i


def test_best_classes_by_recounting():
    r = np.random.default_rng(3)
    for _ in range(5):
        units, c = 30, 5
        pair = r.poisson(1.5, (units, units)).astype(float)
        classes = np.where(np.arange(units) == 0, 0, r.integers(1, c, units))
        one = np.eye(c)[classes]
        got = class_lm.exchange(pair.T @ one, pair @ one, np.diag(pair).copy(), classes, np.arange(1, units), c)
        value = lambda cl: class_lm.likelihood(np.eye(c)[cl].T @ pair @ np.eye(c)[cl])
        for u in range(1, units):
            tried = [value(np.where(np.arange(units) == u, k, classes)) for k in range(1, c)]
            assert np.isclose(value(np.where(np.arange(units) == u, got[u], classes)), max(tried), atol=1e-4)


def test_few_cells_are_added_and_not_multiplied():
    """Words seen once take rows of the table of steps, not a product a step; both ways choose the same."""
    r = np.random.default_rng(12)
    c, words = 16, 300
    n = r.poisson(r.gamma(0.3, 3000, (c, c))).astype(float)
    before, after = np.eye(c)[r.integers(0, c, words)], np.eye(c)[r.integers(0, c, words)]
    own, twice = r.integers(1, c, words), np.zeros(words)
    products = []

    class Step(np.ndarray):
        def __rmatmul__(self, other):
            products.append(1)
            return np.asarray(other) @ np.asarray(self)

        __array_priority__ = 100

        def __array_ufunc__(self, ufunc, method, *args, **kw):
            if ufunc is np.matmul:
                products.append(1)
            return getattr(ufunc, method)(*(np.asarray(x) for x in args), **kw)

    steps = class_lm.small_steps(n)
    few = class_lm.best_classes(before, after, twice, own, n, tuple(np.array(x).view(Step) for x in steps))
    assert not products
    for k in range(words):  # by recounting the whole table
        value = []
        for to in range(1, c):
            m = n.copy()
            m[:, own[k]] -= before[k]
            m[own[k], :] -= after[k]
            m[:, to] += before[k]
            m[to, :] += after[k]
            value.append(class_lm.likelihood(m))
        assert value[few[k] - 1] > max(value) - 1e-4


def test_counts_beyond_a_cell_are_several_cells():
    cells = {"unit": np.array([1, 1, 2]), "after": np.array([0, 1, 1]), "other": np.array([5, 6, 7]), "n": np.array([3, 2 * class_lm.MOST + 9, class_lm.MOST])}
    row = class_lm._packed(4, cells)
    unit, _, other, n = (np.frombuffer(row.column(k)[0].as_py(), t).astype(np.int64) for k, t in class_lm.CELLS.items())
    assert unit.tolist() == [1, 1, 1, 1, 2] and other.tolist() == [5, 6, 6, 6, 7]
    assert n.tolist() == [3, class_lm.MOST, class_lm.MOST, 9, class_lm.MOST]


def test_contexts_are_the_counts_of_pairs(spark):
    r = np.random.default_rng(5)
    docs = [r.integers(1, 50, r.integers(0, 90)).astype(np.uint32) for _ in range(60)]
    units = spark.createDataFrame([(bytearray(x.tobytes()),) for x in docs], "units binary").repartition(4)
    want = Counter()
    for x in docs:
        for a, b in zip([0, *x.tolist()], [*x.tolist(), 0], strict=True):
            want[a, 1, b] += 1
            want[b, 0, a] += 1
    got = Counter()
    for row in class_lm.contexts(units, 50, 3000, class_lm.Model(part_pairs=300)).collect():
        for cell in zip(*(np.frombuffer(row[c], t).tolist() for c, t in class_lm.CELLS.items()), strict=True):
            assert cell[0] % 20 == row.part and cell[:3] not in got
            got[cell[:3]] = cell[3]
    for (u, side, o), n in want.items():
        if u and o:
            assert got[u, side, o] == n
    assert sum(got.values()) >= sum(want.values()) - 2 * len(docs)


def test_words_are_found_as_in_single_texts():
    r = random.Random(8)
    texts = [None, "", " ", " a  b ", *("".join(r.choice(" \t\n\r\x0b\x0c\x1c\x85\xa0 AbZİé字\x00") for _ in range(r.randrange(40))) for _ in range(3000))]
    words, many = class_lm.words_of(pa.array(texts)[1:])  # a slice, as tasks cut batches
    assert words.to_pylist() == [w for t in texts[1:] for w in class_lm.tokens_of(t)]
    assert many.tolist() == [len(class_lm.tokens_of(t)) for t in texts[1:]]
    model = class_lm.Model(endings=50)
    assert class_lm.ending_units(words, 9, model).tolist() == [class_lm.ending_unit(w, 9, model) for w in words.to_pylist()]


def test_rounds_read_the_rows_and_sides_they_need(spark, monkeypatch):
    """The table by halves has the cells of the plain one; a round reads only units that may move and chooses as the plain exchange."""
    r = np.random.default_rng(6)
    docs = [r.integers(1, 300, r.integers(0, 90)).astype(np.uint32) for _ in range(80)]
    units = spark.createDataFrame([(bytearray(x.tobytes()),) for x in docs], "units binary").repartition(4)
    model, c = class_lm.Model(part_pairs=300), 7
    plain, table = (class_lm.contexts(units, 300, 3000, model, by) for by in (False, True))
    want, got, halves = Counter(), Counter(), {}
    for row in plain.collect():
        for u, after, o, n in zip(*(np.frombuffer(row[k], t).tolist() for k, t in class_lm.CELLS.items()), strict=True):
            want[u, after, o] += n
    for row in table.collect():
        x = {k: np.frombuffer(row[k], t) for k, t in class_lm.SIDES.items()}
        halves |= dict.fromkeys(x["unit"].tolist(), row.half)
        for after, k in ((1, "behind"), (0, "before")):
            for u, o, n in zip(np.repeat(x["unit"], x[k]).tolist(), x[f"other_{k}"].tolist(), x[f"n_{k}"].tolist(), strict=True):
                got[u, after, o] += n
    assert got == want and halves[0] == 2**class_lm.HALVES
    classes = np.where(np.arange(300) == 0, 0, r.integers(1, c, 300))
    pairs = np.zeros((300, 300))
    for (u, after, o), n in want.items():
        if after:
            pairs[u, o] += n
    one = np.eye(c)[classes]
    n = class_lm.class_pairs(table, classes, c)
    assert (n == one.T @ pairs @ one).all()
    for turn in (0, 1, 4, 13):
        movable = np.array([u for u in range(1, 300) if ((u * 2654435761 >> 3 + turn // 2 % class_lm.HALVES) + turn) % 2 == 0])
        out = class_lm.moved(table, classes, n, turn)
        assert (out == class_lm.exchange(pairs.T @ one, pairs @ one, np.diag(pairs).copy(), classes, movable, c)).all() and (out != classes).any()
        read = table.where((F.col("half") < 2**class_lm.HALVES) & ((F.shiftright("half", turn // 2 % class_lm.HALVES) + turn) % 2 == 0))
        assert {u for row in read.collect() for u in np.frombuffer(row.unit, "<u4").tolist()} == set(movable.tolist())


@pytest.mark.parametrize("n_units", [50, 2**24])
def test_counts_are_added_up_beyond_a_cell(spark, n_units):
    """Of a pair that stands more often than a cell counts, summed on the way and at the end, by both orders."""
    docs = [np.full(50_000, 1), np.tile([1, 2, 3], 30_000), np.arange(1, 40)] * 3
    units = spark.createDataFrame([(bytearray(x.astype(np.uint32).tobytes()),) for x in docs], "units binary").repartition(2)
    want = Counter((a, b) for x in docs for a, b in zip([0, *x.tolist()], [*x.tolist(), 0], strict=True))
    got = Counter()
    for row in class_lm.contexts(units, n_units, 10, class_lm.Model(part_pairs=2)).collect():
        for u, after, o, n in zip(*(np.frombuffer(row[k], t).tolist() for k, t in class_lm.CELLS.items()), strict=True):
            got[u, after, o] += n
    assert want[1, 1] > class_lm.MOST
    assert all(got[a, 1, b] == got[b, 0, a] == n for (a, b), n in want.items() if a and b)


def test_nothing_to_learn_from(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    df = spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")
    got = class_lm.score_corpus(df, class_lm.Model(classes=4, endings=8, rounds=1)).collect()
    assert all((r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and math.isfinite(r.score) for r in got)


def test_class_model_beats_single_words_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = class_lm.score_corpus(docs, class_lm.Model(rounds=4))
    pp = {k: {r.held_out: r.perplexity for r in class_lm.perplexity(scores, k).collect()} for k in ("base_score", "score")}
    assert pp["score"][True] < 0.5 * pp["base_score"][True]


def test_probabilities_sum_to_at_most_one():
    """Of every next word and the unseen one, after any class."""
    r = np.random.default_rng(0)
    n = r.integers(0, 50, (6, 6)).astype(float)
    size = n.sum(0)
    t = (n + 50 * size / size.sum()) / (n.sum(1, keepdims=True) + 50)
    assert np.allclose(t.sum(1), 1)


def test_exchange_raises_the_likelihood():
    """Words of two kinds that always alternate are told apart."""
    units = 1 + 12
    kind = np.arange(units) % 2
    after = np.zeros((units, units))
    for a in range(1, units):
        for b in range(1, units):
            after[a, b] = 10.0 if kind[a] != kind[b] else 0.0
    after[0, 1:] = after[1:, 0] = 1.0
    classes = np.array([0, 1, 1, 2, 2, 1, 1, 2, 2, 1, 1, 2, 1])
    first = None
    for turn in range(36):
        one = np.eye(3)[classes]
        by_after, by_before = after @ one, after.T @ one
        value = class_lm.likelihood(class_lm.transitions(by_after, classes, 3))
        if first is None:  # one unit's move is the best of recomputing everything
            tried = [np.where(np.arange(units) == 1, c, classes) for c in (1, 2)]
            best = max((class_lm.likelihood(class_lm.transitions(after @ np.eye(3)[c], c, 3)), c[1]) for c in tried)[1]
            assert class_lm.exchange(by_before, by_after, np.diag(after).copy(), classes, np.array([1]), 3)[1] == best
        first = value if first is None else first
        movable = np.array([1 + turn % 12])
        classes = class_lm.exchange(by_before, by_after, np.diag(after).copy(), classes, movable, 3)
    assert value > first and len(set(classes[1::2])) == len(set(classes[2::2])) == 1 and classes[1] != classes[2]


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, body):
    digits = re.sub("[^0-9]", "", body)
    if kind == "ip":
        return all(int(x) <= 255 for x in body.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


TEXTS = [
    None, "", "a@b.c_d@e.f x.y@z-1.co.uk. q@@r.s a.b.c@d a@b. a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255 1.2.3.4.", "x 4111 1111 1111 1111 y 4111-1111-1111-1112 é😀4111111111111111 4111  1111",
    "+1 (743) 555-3824 12 +12345678901234567 +1234567 +1 2", "😀" * 5 + " a@b.co", "1" * 60_000, "a." * 30_000 + "@", "+1" + " " * 20_000, "a" * 50_000 + "@" + "b." * 20_000 + "c", "a@b.c " * 3000, "+" * 5000 + "1", "1.2.3." * 5000,
]


def test_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({c: F.lit("x") for c in (*CLASH, "email", "ip", "_text")})
    for r in personal_data.find_personal_data(df).collect():
        spans = plain_spans(TEXTS[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in BASE), TEXTS[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_sums_before_each_element(spark):
    r = random.Random(6)
    rows = [([r.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 8, 9, 10, 27, 28, 80, 82, 700)]
    df = spark.createDataFrame(rows, "x array<int>")
    for width in (3, 64):
        for r in df.select("x", personal_data.summed(F.col("x"), width).alias("s")).collect():
            assert r.s == [sum(r.x[:k]) for k in range(len(r.x))]


def test_work_grows_with_the_matches_and_not_their_square(spark):
    small = spark.createDataFrame([(0, "a@b.co 1.2.3.4")], "doc_id long, text string")
    took = []
    for df in (small, spark.createDataFrame([(0, "a@b.co " * 80_000 + "1.2.3.4 " * 40_000 + "x(at)y.de " * 10_000)], "doc_id long, text string")):
        start = time.time()
        got = personal_data.find_personal_data(df).collect()[0]
        took.append(time.time() - start)
    assert (got.n_email, got.n_ip) == (80_000, 40_000) and got.spans.count("email") == 90_000 and got.spans.startswith("email:0:6,email:7:13,")
    assert took[1] < took[0] + 10


def test_looser_spans_are_added_and_plain_numbers_are_not(spark):
    texts = ["mail me at bob(at)host.com", "call (212) 555-1234 now", "tel 212-555-1234", "release 1234.5678.1234.5678 build", "order 111-222-3333 page", "nothing at all"]
    texts += [f"call +1 (212) 555-{k:04d} or mail a{k}@host.com from host 8.8.4.{k}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.find_personal_data(df).collect()}
    assert got[0] == "email:11:26" and got[1] == "phone:5:19" and got[5] == "" and not got[3]


def test_reliabilities_separate_good_and_bad_labelers():
    rows = []
    for truth, n in ((1, 600), (-1, 400)):
        for bits in range(8):
            v = [truth if bits >> k & 1 else -truth for k in range(3)]
            share = np.prod([p if bits >> k & 1 else 1 - p for k, p in enumerate((0.95, 0.9, 0.6))])
            rows.append({"kind": "email", "regex": v[0], "gazetteer": v[1], "context": v[2], "shape": 0, "width": 1, "n": n * share})
    prior, good = personal_data.reliabilities(rows)["email"]
    assert abs(prior - 0.6) < 0.06 and good["regex"][0] > good["context"][0] + 0.15 and good["gazetteer"][1] > good["context"][1] + 0.15


def test_spans_of_odd_tables(odd, none):
    assert personal_data.find_personal_data(odd).count() == len(odd_rows())
    assert personal_data.find_personal_data(none).count() == 0


# mixing


def plain_targets(sizes, weights):
    left, out = 1.5 * sum(sizes), [0.0] * len(sizes)
    capped = set()
    while len(capped) < len(sizes):
        unit = (left - sum(2 * sizes[k] for k in capped)) / sum(w for k, w in enumerate(weights) if k not in capped)
        over = {k for k, w in enumerate(weights) if k not in capped and unit * w > 2 * sizes[k]}
        for k, w in enumerate(weights):
            out[k] = 2.0 * sizes[k] if k in capped else unit * w
        if not over:
            return out
        capped |= over
    return [2.0 * s for s in sizes]


def test_targets():
    r = random.Random(2)
    for _ in range(200):
        sizes = [r.choice([0, 1, 50, 1000, 10**6]) for _ in range(r.randint(1, 9))]
        weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        got = mixing.targets(sizes, weights)
        assert np.allclose(got, plain_targets(sizes, weights))
        assert np.isclose(sum(got), 1.5 * sum(sizes)) and all(g <= 2 * s + 1e-6 for g, s in zip(got, sizes, strict=True))


def test_tree_quotas_add_up():
    quotas = [1000, 3, 0, 77]
    for shards in (1, 2, 7, 64):
        parts = [mixing.shard_quotas(quotas, k, shards, 5) for k in range(shards)]
        assert (sum(n for _, n in parts) == quotas).all()
        for s in range(len(quotas)):
            runs = sorted((int(f[s]), int(n[s])) for f, n in parts if n[s])
            assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:], strict=False))
        totals = [int(n.sum()) for _, n in parts]
        assert max(totals) - min(totals) <= math.ceil(math.log2(shards)) + 1


def test_mix(spark, none):
    rows = [(k, prose(50 + k % 40, k), "en", ["a", "b", "c", "d", None][k % 5], 1) for k in range(600)] + [(9000, None, None, None, None), (9001, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASH})
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    options = {"shards": 6, "block_words": 700}
    got = mixing.mix(df, **options)
    assert got.columns == [*df.columns, *mixing.TAKE]
    took = Counter(r.doc_id for r in got.collect())
    assert max(took.values()) <= 2
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r[0])
    names = sorted((s for s in by if s is not None)) + [None]
    goal = plain_targets([sum(size[i] for i in by[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    for s, want in zip(names, goal, strict=True):
        assert abs(sum(took[i] * size[i] for i in by[s]) - want) <= 90, s
    assert by_id(mixing.mix(df.repartition(9), **options).collect(), "doc_id", "_pass", "_shard", "_place") == by_id(got.collect(), "doc_id", "_pass", "_shard", "_place")
    assert mixing.mix(none).count() == 0


def test_shards_are_written_shuffled(spark, odd, tmp_path):
    mixed = mixing.mix(odd, shards=3, block_words=500)
    mixing.write_shards(mixed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == mixed.count()
    for name in (tmp_path / "out").glob("_shard=*/*.parquet"):
        places = [r._place for r in spark.read.parquet(str(name)).collect()]
        assert places == sorted(places)


def test_taken_words_are_exactly_those_of_the_permuted_prefix(spark):
    """With documents of one word a block's cut is exact: each source gives its target."""
    rows = [(k, "w", "en", "abc"[min(2, k % 7)], 1) for k in range(4200)]
    took = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, DOCS), block_words=100, shards=5).collect():
        took[r.source] += 1
    size = Counter(r[3] for r in rows)
    goal = plain_targets([size[s] for s in "abc"], [5, 2, 1])
    assert [took[s] for s in "abc"] == [round(g) for g in goal]


def test_shards_follow_the_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    rows = [(k, prose(50, k), "en", "ab"[k % 2], 1) for k in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(df, block_words=200)
    assert 10 <= mixed.select("_shard").distinct().count() <= 15
    places = mixing.shuffled(mixed).select(F.spark_partition_id().alias("p"), "_shard", "_place").collect()
    assert len({r._shard for r in places}) == len({(r.p, r._shard) for r in places})
    assert [(r._shard, r._place) for r in places if r.p == places[0].p] == sorted((r._shard, r._place) for r in places if r.p == places[0].p)


def test_rows_without_id_and_of_one_id_reach_the_target(spark):
    rows = [(k, prose(10, k), "en", "a", 1) for k in range(200)] + [(None, prose(10, 1000 + k), "en", "y", 1) for k in range(200)] + [(7, prose(10, 2000 + k), "en", "z", 1) for k in range(200)]
    took = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, DOCS), block_words=300, shards=3).collect():
        took[r.source] += len(r.text.split())
    for s, want in zip("ayz", plain_targets([2000, 2000, 2000], [5, 2, 1]), strict=True):
        assert abs(took[s] - want) <= 10, s


def test_shards_follow_the_words_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 64)
    sized = spark.range(3000).selectExpr("id", "'a' AS source", "id % 7 * 0 + 4000000 AS size")  # 1.2e10 words
    plan = mixing.plan_mix(sized, max_blocks=64)
    assert not plan.sent and 1500 <= plan.shards <= 2300
    words = plan.sources.first()["source_size"]
    assert words * 1.5 / plan.shards <= 1.1 * mixing.SHARD_WORDS
    both = [{r.row.id: sorted((t["pass"], t["shard"]) for t in r.takes) for r in mixing.with_takes(sized.withColumn("key", F.xxhash64("id")), mixing.Mix(plan.sources, plan.blocks, plan.seed, plan.shards, sent), F.col("key")).collect()} for sent in (False, True)]
    assert both[0] == both[1] and abs(sum(map(len, both[0].values())) - 4500) <= 1


def test_plan_is_bounded(spark):
    sized = spark.createDataFrame([(k, "a", 100) for k in range(1000)], "id long, source string, size long")
    plan = mixing.plan_mix(sized, block_words=10, max_blocks=16)
    assert plan.blocks.count() <= 17


# archives


def test_archives(spark, tmp_path):
    big, small = "<p>" + prose(60, 1) + "</p>\r\n\r\nWARC/1.1\r\n", "<p>tiny</p>"
    rows = [(k, f"http://h.example/{k}?q=a b\r\nX: y", h) for k, h in enumerate([big, small, big, small, None, "", "é" * 60, "é" * 60, big])] + [(8, "again", big), (None, None, big), (50, "x" * 5000, "\u3000" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in (*CLASH, "path", "first")})
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(x for x in groups[h or ""] if x is not None) if len(raw) >= 100 and len(groups[h or ""]) > 1 else i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    for size in (1, 1 << 20):
        manifest = web_archive.write_archives(df.repartition(3), archive_bytes=size)
        got = web_archive.read_records(manifest, chunk=1000, payload=True)
        assert by_id(got.collect(), "id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    payloads = {r.id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert payloads[0] == big.encode() and payloads[4] == b""
    store, path = files.filesystem(manifest.first().path)
    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:  # others can read them
        assert set(z.namelist()) == {web_archive.RECORDS, web_archive.INDEX} and z.testzip() is None
    assert web_archive.read_records(web_archive.write_archives(df.where("false"))).count() == 0


def test_records_beside_each_other_are_one_read():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 5000, 5), ("b", 5005, 5), ("b", 5000, 5), ("b", 5005, 20)]
    assert web_archive.spans(places, gap=100, most=50) == [(0, 3), (3, 4), (4, 5), (5, 7)]
    assert web_archive.spans(places, gap=100, most=20) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)]
    assert web_archive.spans([]) == []


def reader(raw):
    return lambda at, n: raw[at : at + n]


def test_zip64_directories(tmp_path):
    """A directory whose every number is in its ZIP64 places, with a comment that holds the end mark."""
    body, name = b"hello", b"archive/data.warc.gz"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5)
    extra = struct.pack("<HH", 0xCAFE, 2) + b"zz" + struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(body)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(entry), 1)
    comment = b"note PK\x05\x06 " + b"x" * 30
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    raw = local + body + entry + end64 + locator + end
    (member,) = web_archive.members(reader(raw), len(raw))
    assert member == web_archive.Member(name.decode(), 0, 5, 0)
    start = web_archive.stored_at(reader(raw), member)
    assert raw[start : start + 5] == body


def test_index_lines_are_sorted_and_name_their_places(spark, tmp_path):
    rows = [(1, "http://b.Example.com:8080/P?Q=1", "x"), (2, "https://a.org", "y"), (3, None, "z"), (4, "no url\nat all", "w"), (None, "http://[bad/", "v")]
    (path,) = [r.path for r in web_archive.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w")).collect()]
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        lines, records = z.read(web_archive.INDEX).decode().splitlines(), z.read(web_archive.RECORDS)
    assert lines == sorted(lines) and len(lines) == 5
    by_page = {}
    for line in lines:
        key, time, told = line.split(" ", 2)
        told = json.loads(told)
        assert len(time) == 14 and told["filename"] == "data.warc.gz"
        by_page[told.get("page")] = key
        raw = records[int(told["offset"]) : int(told["offset"]) + int(told["length"])]
        assert told["digest"] == web_archive.parse_record(gzip.decompress(raw))[0]["warc-payload-digest"]
    assert by_page[1] == "com,example,b:8080)/p?q=1" and by_page[2] == "org,a)/" and by_page[3] == "-"


def test_packages_of_others(spark, tmp_path):
    def other(kind, uri, block, **more):
        head = "".join(f"{k}: {v}\r\n" for k, v in ({"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1-2>", "WARC-Target-URI": uri, "WARC-Block-Digest": "sha1:ABC", "Content-Length": len(block)} | more).items())
        return gzip.compress(("WARC/1.0\r\n" + head + "\r\n").encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"
    files_ = {"archive/one.warc.gz": [other("warcinfo", "", b"software: x\r\n"), other("response", "http://a/", http)], "archive/two.warc.gz": [other("response", "http://b/", http + b"2"), other("revisit", "http://c/", http[:-4], **{"WARC-Payload-Digest": "sha1:XYZ"})]}
    lines = ["!meta {}"]
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        for name, parts in files_.items():
            at = 0
            for part in parts:
                lines.append(f'a,b)/ 20200101000000 {json.dumps({"url": "u", "length": str(len(part)), "offset": str(at), "filename": name.split("/")[1]})}')
                at += len(part)
            z.writestr(name, b"".join(parts))
        half = len(lines) // 2
        z.writestr("indexes/index.cdx.gz", b"".join(gzip.compress(("\n".join(x) + "\n").encode()) for x in (lines[:half], lines[half:])))
        z.writestr("datapackage.json", "{}")
    got = web_archive.read_records(web_archive.packages(spark, str(tmp_path)), payload=True).collect()
    assert sorted((r.record_type, r.url, r.id, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got) == sorted([
        ("warcinfo", "", None, 13, hashlib.sha256(b"software: x\r\n").hexdigest(), b"software: x\r\n"),
        ("response", "http://a/", None, 4, hashlib.sha256(b"body").hexdigest(), b"body"),
        ("response", "http://b/", None, 5, hashlib.sha256(b"body2").hexdigest(), b"body2"),
        ("revisit", "http://c/", None, 0, "sha1:XYZ", b""),
    ])
    with zipfile.ZipFile(tmp_path / "bad.wacz", "w") as z:
        z.writestr("archive/one.warc.gz", b"x")
        z.writestr("indexes/index.cdxj", 'a 2020 {"offset": 0, "length": 1, "filename": "gone.warc.gz"}\n')
    read = (tmp_path / "bad.wacz").read_bytes()
    with pytest.raises(ValueError, match="gone"):
        web_archive.places_in(lambda at, n: read[at : at + n], len(read))


def test_broken_archives(tmp_path):
    with pytest.raises(ValueError, match="no end"):
        web_archive.members(reader(b"x" * 100), 100)
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    raw = path.read_bytes()
    (member,) = web_archive.members(reader(raw), len(raw))
    with pytest.raises(ValueError, match="compressed"):
        web_archive.stored_at(reader(raw), member)
    good = web_archive.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert web_archive.parse_record(good)[1] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        web_archive.parse_record(good.replace(b"payload\r\n\r\n", b"payloaX\r\n\r\n"))


# URLs

URLS = [None, "", "no scheme", "http://", "http://A.EXAMPLE.net/en/x", "https://example.net/en", "https://net", "https://net/", "https://xnet/", "http://a.b.example.com/de/?q#f", "http://example.com/DE/", "x://y://org/fr/", "http://org/fr/1", "http://q.org?/fr/", "http://example.net/english/en/", "http://..net/", "http://example.com//de/"]
RULES = [*[url_filter.Rule(*x) for x in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("allow", "example.net", "/eng"), ("block", "example.net", "/e"), ("block", "b.example.com", ""), ("allow", "y:", ""), ("block", "com", "//"), ("allow", "net", "/"))]]


def plain_verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host), r.action == "block"), default=None)
    return host, path, best and best.host + best.path, best.action if best else "allow"


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate([*URLS, *URLS[:5]])), "page_id long, url string").withColumns({c: F.lit("x") for c in (*CLASH, "verdict", "_best")})
    want = sorted(((k, *plain_verdict(u, RULES)) for k, u in enumerate([*URLS, *URLS[:5]])), key=repr)
    for most in (1_000_000, 1):
        got = url_filter.judge_urls(df, RULES, max_broadcast=most)
        assert by_id(got.collect(), "page_id", "host", "path", "rule", "verdict") == want
        assert set(df.columns) <= set(got.columns)
    assert url_filter.judge_urls(df.where("false"), RULES).count() == 0


# token ids


def test_codes_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000, (1 << 20) + 3):
        x = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        assert (token_ids.decode(*token_ids.encode(x), n) == x).all()


def test_frequent_ids_take_one_byte():
    ids = np.array([70_000] * 9 + [5] * 3 + [9], np.uint32)
    by_rank, ranks = token_ids.ranked(ids)
    assert by_rank.tolist() == [70_000, 5, 9] and (by_rank[ranks] == ids).all() and len(token_ids.encode(ranks)[1]) == len(ids)


ODD = ["é ́x AİB \x1c! !\x85! I'LL <|endoftext|>a b<|startoftext|> \u00a0q\u3000z <|STARTOFTEXT|>. H̱. Á, it's. don't' rock'n'roll! Σας. ΟΔΟΣ. x…. 12. a1. 1a! ª. ʰ! ﬁ. ß: ''s. .a.b. ...", "don't ΑΣ 12345 ½ ²³", "x" * 3000]


def test_token_files(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    df = odd.select("doc_id", "text", "n").union(spark.createDataFrame([(900 + k, x, "x") for k, x in enumerate(ODD)], "doc_id long, text string, n string"))
    rows = sorted([(r[0], r[1]) for r in odd_rows()] + [(900 + k, x) for k, x in enumerate(ODD)], key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows]
    manifest = token_ids.write_ids(df.repartition(4), path, file_ids=500)
    assert manifest.count() > 3
    got = token_ids.read_ids(spark, manifest, tokens=True).orderBy("start").collect()
    assert [r.id for r in got] == [i for i, _ in rows]
    assert [r.n_tokens for r in got][2:] == [len(x) for x in ids][2:]
    for r, x in zip(got[2:], ids[2:], strict=True):
        assert r.tokens == x and r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes())
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert token_ids.encode_corpus(none, path).count() == 0
    with pytest.raises(ValueError):
        token_ids.parse_file(b"x" * 100)


def test_letters_that_end_in_a_combining_mark(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), token_ids.WordIds(path)
    # every letter that composing changes or lower-casing makes longer
    letters = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha() and (len(c.lower()) > 1 or not unicodedata.is_normalized("NFC", c))]
    made = [w for c in letters for w in (f"{c}.", f"A{c},", f"e\u0301{c}!?", f"{c}\u0301;", f"a.{c}...")]
    made += ["AL\u0130.", "\u09b9\u09df,", "\u092b\u0930\u0958!", "\ufb2a:"]
    assert [w for w in made if np.frombuffer(words.encode(w.encode()), "<u4").tolist() != tokenizer.encode(w, add_special_tokens=False).ids] == []
    texts = ["AL\u0130. x", "\u09b9\u09df, y", "z"]
    got = token_ids.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    ids = [[*tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def mismatches(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), token_ids.WordIds(path)
    assert words.apart
    out = []
    for k in range(0, len(texts), 1000):
        some = texts[k : k + 1000]
        for t, got, want in zip(some, words.of(some), tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            if np.frombuffer(got, "<u4").tolist() != want.ids:
                out.append(t)
    return out


def test_every_character_beside_marks():
    """Before a mark, behind one, alone and doubled; of the large blocks of one
    kind of character, every 37th."""
    large = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xE000, 0xF900), (0x17000, 0x18D00), (0x20000, 0x110000))
    chars = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000 and (k % 37 == 0 or not any(a <= k < b for a, b in large)) and unicodedata.category(chr(k)) != "Cn"]
    assert len(chars) > 39_000
    assert mismatches([f"{c}! !{c} {c} {c}{c} a{c}, {c}a." for c in chars]) == []


def test_random_texts_have_the_librarys_ids():
    r = random.Random(12)
    some = "aZé.,!'-\u0301 \t\n\x0b\x1c\x85\u00a0\u3000\u0130\u03a3ς\u0928\u093c\u0958\u09df1٣½<|>_s\u0338=ßǅ\u1e9b\u0323ﬁ中か가\u200d😀"
    texts = ["".join(r.choice(some) for _ in range(r.randint(1, 14))) for _ in range(100_000)]
    assert mismatches(texts) == []
    assert mismatches([t.replace("a", "<|endoftext|>") for t in texts[:2000]]) == []


def test_added_tokens_are_cut_out_first(tmp_path):

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for k, content in enumerate(["[PAD]", "wor", "d.", "(("]):
        spec["added_tokens"].append({"id": 49_408 + k, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "added.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    ids, whole = token_ids.WordIds(path), Tokenizer.from_file(path)
    assert ids.apart
    for text in ["x[PAD]", "[PAD]", "[PAD", "word", "words.", "sword...", "x((!", "a[PAD]b.", "end.", "x(", "plain text,"]:
        got = [int(i) for w in text.split() for i in np.frombuffer(ids[w.encode()], "<u4")]
        assert got == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    assert token_ids.by_words(path) == name.startswith("word")
    texts = [None, "", "Two  words\nand more", "é x İ! ", " lead", *ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    manifest = token_ids.write_ids(df, path, end=100_000, file_ids=50)
    got = token_ids.read_ids(spark, manifest, tokens=True).orderBy("id").collect()
    assert [r.tokens for r in got] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 100_000] for t in texts]
    assert manifest.select("ranks").distinct().count() == 1  # one table for all files


# packing


def check_packing(rows, pieces, sizes):
    want = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for i, t in rows)
    docs, bins = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[(p.doc_id, p.copy, sum(1 for _ in ()))].append((p.start, p.length))
        bins[p.bin].append((p.offset, p.length, p.capacity))
    got = Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[(p.doc_id, p.copy)].append((p.start, p.length))
    for (doc, _), parts in by_doc.items():
        # several rows of one id and other lengths can share a copy number
        for start, length in parts:
            got[doc] += length
    assert got == Counter({i: 0 for i, _ in want}) + sum((Counter({i: n * k}) for (i, n), k in want.items()), Counter())
    for parts in bins.values():
        at = 0
        for offset, length, capacity in sorted(parts):
            assert offset == at
            at += length
        assert capacity == min(s for s in sizes if s >= at)


@pytest.mark.parametrize("sizes", [(512, 1024, 2048, 4096, 8192), (64,), (10, 100)])
def test_packing(odd, none, sizes):
    got = packing.pack(odd, sizes=sizes, group_rows=20).collect()
    check_packing([(r[0], r[1]) for r in odd_rows()], got, sizes)
    assert packing.pack(none, sizes=sizes).count() == 0


def test_packing_is_dense_and_repeats(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = packing.pack(docs).collect()
    bins = {r.bin: r.capacity for r in got}
    assert sum(r.length for r in got) >= 0.93 * sum(bins.values())
    assert by_id(packing.pack(docs.repartition(7)).collect(), "doc_id", "piece", "bin", "offset") == by_id(got, "doc_id", "piece", "bin", "offset")
    by_group = {}
    for r in got:
        if r.offset == 0:
            by_group.setdefault(r.bin.split("-")[0], []).append(r.capacity)
    assert any(x != sorted(x, reverse=True) for x in by_group.values())
    assert [(r.bin, r.offset) for r in packing.pack(docs).collect()] == [(r.bin, r.offset) for r in got]


@pytest.mark.parametrize("sizes", [(512, 1024, 2048, 4096, 8192), (7,)])
def test_sequences_hold_the_texts(spark, odd, tmp_path, sizes):
    """Written, read back and put together again, the documents are what they were."""
    packed = packing.pack(odd, sizes=sizes, group_rows=20)
    path = packing.write_sequences(packed, str(tmp_path / "sequences"))
    back = packing.read_sequences(spark, path)
    assert sorted(map(str, back.select(*sorted(back.columns)).collect())) == sorted(map(str, packed.select(*sorted(back.columns)).collect()))
    got = Counter((r.doc_id, r.text, r.tokens) for r in packing.texts_of(back).collect() if r.doc_id != 4 and r.doc_id is not None)
    assert got == Counter((i, t or "", len((t or "").encode().split()) + 1) for i, t, *_ in odd_rows() if i != 4 and i is not None)
    for r in back.where("body <> ''").collect():
        assert len(r.body.encode().split()) in (r.length, r.length - 1)


def test_texts_are_cut_before_words(spark):
    for text in ["", " ", "a", "  a b  c ", "a b c d e f g", "\n" + "é\tx " * 50, "x" * 5000 + " y" * 7]:
        n = len(text.encode().split()) + 1
        df = spark.createDataFrame([(text, n)], "t string, n long")
        for largest in (1, 2, 3, 7, 8):
            got = df.select(packing.pieces(F.col("t"), F.col("n"), largest).alias("p")).first().p
            assert "".join(got).split() == text.split() and len(got) == -(-n // largest)
            if n > 1:
                assert "".join(got) == text
            assert all(len(p.encode().split()) == largest for p in got[:-1])


def test_rows_that_are_there_very_often_fill_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "HOT", 4)
    rows = [(1, "a b c")] * 100 + [(None, "d")] * 50 + [(k, prose(5, k)) for k in range(2, 30)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sizes=(16,), group_rows=10).collect()
    keys = Counter((r.doc_id, r.copy) for r in got)
    assert max(keys.values()) == 1 and sum(keys.values()) == len(rows)
    assert max(Counter(r.bin.split("-")[0] for r in got).values()) < 80


def test_several_lengths_cost_less_than_any_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = [x.n for x in docs.select((common.words_in(F.col("text")) + 1).alias("n")).collect()]

    def packed(sizes):
        parts = sorted((min(max(sizes), n - k) for n in r for k in range(0, n, max(sizes))), reverse=True)
        return packing.cost(packing.best_fit(parts, sizes)[2], sum(r))

    together = packed(packing.SIZES)
    assert all(together < packed((s,)) for s in packing.SIZES)


def plain_best_fit(lengths, sizes):
    """Looks at every open bin for each piece."""
    used, room, out = [], [], []
    for k, n in enumerate(lengths):
        fit = [b for b in range(len(used)) if room[b] >= n]
        if fit:
            b = min(fit, key=lambda b: (room[b], b))
        else:
            b = len(used)
            used.append(0)
            room.append(packing.opening_size(n, sum(lengths[k + 1 :]), len(lengths) - k - 1, sorted(sizes)))
        out.append((b, used[b]))
        used[b] += n
        room[b] -= n
    return [b for b, _ in out], [o for _, o in out], [min(s for s in sizes if s >= u) for u in used]


def test_best_fit_is_what_looking_at_every_bin_gives():
    r = random.Random(4)
    for _ in range(60):
        lengths = sorted((r.randint(1, 64) for _ in range(r.randint(0, 120))), reverse=True)
        assert packing.best_fit(lengths, (16, 32, 64)) == plain_best_fit(lengths, (16, 32, 64))


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, capacity = packing.best_fit([70, 60, 40, 30], [100])
    assert bins == [0, 1, 1, 0] and offsets == [0, 0, 60, 70] and capacity == [100, 100]
    assert packing.best_fit([5], [8, 64])[2] == [8]


# shared


def test_scratch_is_the_sessions(spark):
    assert common.scratch(spark).startswith("file:")
    assert common.fresh(spark.range(1).withColumn("_LOST", F.lit(1)), "lost") == "__lost"
