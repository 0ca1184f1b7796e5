import random
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import documents

from rosterloom.llm import ngram_join as nj


def sets_of(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def brute(texts, ids, words, percent):
    sets = sets_of(texts, words)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def corpus(seed=5, bases=25):
    """Texts in families: each text edited a little from another of its family, so that some links only chain."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(bases):
        family = [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 5, 9, 14, 30, 80, 200, 600]))]]
        for _ in range(rnd.choice([0, 1, 3, 9])):
            t = list(rnd.choice(family))
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.3:
                t.append(rnd.choice(words))
            family.append(t)
        texts += [rnd.choice([" ", "\n", "\t "]).join(w.upper() if rnd.random() < 0.1 else w for w in t) for t in family]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("words,percent,limit", [(3, 90, 10**6), (5, 80, 10**6), (3, 90, 0)])
def test_components_equal_brute_force(spark, words, percent, limit):
    texts = [*corpus(), "", None, " \n", "x", "X", "x y", "X  Y", "É x y z", "é x y z"]
    ids = random.Random(2).sample(range(1000), len(texts))
    got = nj.near_components(documents(spark, texts, ids, extra=("n int, component_id string, key int", (1, "z", 2))), words=words, percent=percent, broadcast_bytes=limit)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(texts, ids, words, percent)


def test_hidden_middle(spark):
    """Every edited copy links only with the original, which has the largest id: the second round has to find it."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(10):
        t = list(base)
        t[5 + 11 * k] = f"e{k}"
        t[(9 + 11 * k + 55) % 120] = f"f{k}"
        texts.append(" ".join(t))
    texts.append(" ".join(base))
    assert rnd
    got = {r["doc_id"]: r["component_id"] for r in nj.near_components(documents(spark, texts), words=3, percent=90).collect()}
    assert got == {i: c for i, (_, c) in brute(texts, list(range(11)), 3, 90).items()}
    assert set(got.values()) == {0}


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = documents(spark, [a, a + " more", None, "", "other words here", a], ids=[4, 3, 8, 9, 10, 5])
    kept = nj.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 8, 9, 10]


def test_repeated_rows_null_ids_and_no_rows(spark):
    a = " ".join(f"a{i}" for i in range(40))
    got = nj.near_components(documents(spark, [a, a, a, a], ids=[7, 7, None, 9]), words=3, percent=90).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (7, 7), (7, 7), (9, 7)]
    assert nj.near_components(documents(spark, ["x"]).limit(0)).collect() == []


def test_one_id_with_several_texts(spark):
    """Rows with one id are one document: it links by any of its texts, and no row comes twice."""
    docs = documents(spark, ["a b c d", "x y z w", "a b c d", "x y z w", "q r s t", "q r s t", "u v"], ids=[1, 2, 3, 3, 3, 9, 3])
    got = nj.near_components(docs, words=3, percent=90).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1), (3, 2, 1), (3, 2, 1), (9, 2, 1)]
    assert [r["doc_id"] for r in nj.near_dedup(docs, words=3, percent=90).collect()] == [1]


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_hot_key_spans_tasks(spark, tasks):
    """Neighbours of a key over few and many ranges: all documents of a key are chained together."""
    rnd = random.Random(4)
    rows = [(k, d) for d in range(400) for k in (7, 100 + d // 2, 1000 + d)] + [(7, 3), (7, 3), (55, 1)]
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = [tuple(r) for r in nj._neighbours(spark.createDataFrame(rows, "key long, doc long")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((k, d) for k, d, *_, place in got if place) == sorted({(k, d) for k, d, *_, place in got if place})
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for k, d, hub, prev, _ in got:
        root[find((k, d))] = find((k, hub))
        root[find((k, d))] = find((k, prev))
    heads = {}
    for k, d, _, _, place in got:
        if place == 0:
            root[find((k, d))] = find(heads.setdefault(k, (k, d)))
    for key, n in ((7, 400), *((100 + i, 2) for i in range(200))):
        docs = {(k, d) for k, d in root if k == key}
        assert len(docs) == n and len({find(x) for x in docs}) == 1, key
    assert not [k for k, *_, place in got if place and (k >= 1000 or k == 55)]


def test_exact_round_in_blocks(spark, monkeypatch):
    """All similar pairs of different components under a key, each once, with blocks of a few documents."""
    monkeypatch.setattr(nj, "_BLOCK", 4)
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 - c], rnd.integers(0, 2**63, c, dtype=np.uint64)))) for c in rnd.integers(0, 200, 60)]
    comp = [i % 3 if i < 30 else i for i in range(60)]
    members = spark.createDataFrame([(k, i, comp[i]) for i in range(60) for k in (5, 6)], "key long, doc long, comp long")
    facts = spark.createDataFrame([(i, len(s), nj.short_sketch(s, nj.bands(90).sketch_longs(len(s))).tolist()) for i, s in enumerate(sets)], "doc long, n long, sketch array<long>")
    got = nj._across(members, facts, 90).collect()
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if comp[i] != comp[j] and 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    assert len(got) == len(set(map(tuple, got))) and near <= set(map(tuple, got)) and near


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_similar_sets_share_a_key(percent):
    rnd = np.random.default_rng(1)
    b = nj.bands(percent)
    for n in [1, 2, 4, 5, 9, 10, 11, 19, 20, 40, 77, 150, 400, 2500]:
        for _ in range(12):
            x = rnd.integers(0, 2**63, n, dtype=np.uint64)
            d = b.differences(2 * n)
            swap = d // 2
            y = np.concatenate((x[: n - swap], rnd.integers(0, 2**63, swap, dtype=np.uint64)))
            x, y = np.unique(x), np.unique(y)
            assert set(nj.piece_keys(x, percent)) & set(nj.piece_keys(y, percent)), n
            y = x[: -(-percent * n // 100)]
            assert set(nj.piece_keys(x, percent)) & set(nj.piece_keys(y, percent)), n
