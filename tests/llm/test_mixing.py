import random

import pytest
from helpers import documents

from rosterloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), limit=3):
    """Share out, stop at the limit, share out the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > limit * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = float(limit * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def table(spark, seed=1, n=600):
    rnd = random.Random(seed)
    sources = [rnd.choice(["a", "b", "b", "b", "é", "Z", None, "tiny"]) if i else "tiny" for i in range(n)]
    sources = ["a" if s == "tiny" and i else s for i, s in enumerate(sources)]
    texts = [" ".join(["w"] * rnd.choice([1, 3, 10, 40, 0])) for _ in range(n)]
    texts[:4] = ["one two", None, "", " \t\n"]
    return documents(spark, texts, sources=sources, extra=("size string, target int, weight double", ("z", 1, 2.0)))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_mix(spark, limit):
    docs = table(spark)
    rows = mixing.mix(docs, broadcast_limit=limit).collect()
    sizes, taken, most = {}, {}, {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    assert len(rows) == docs.count()
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    want = targets(sizes)
    got = {r["source"]: r["target"] for r in rows}
    for s, t in want.items():
        assert got[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_apply_repeats_rows(spark):
    docs = table(spark, n=200)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {d: c for d, c in copies.items() if c}


def test_inclusion_follows_the_weights(spark):
    docs = documents(spark, [f"w{i}" for i in range(3000)], sources=["a"] * 1000 + ["b"] * 2000)
    w = docs.withColumn("odds", (docs.doc_id % 2 + 0.5))
    rows = mixing.mix(w, weights=(1, 5), weight_col="odds").filter("source = 'a'").collect()
    share = [sum(r["copies"] for r in rows if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert abs(sum(share) - 500) <= 1 and share[1] == pytest.approx(3 * share[0], rel=0.15)


def test_longer_documents_come_more_often(spark):
    """Expected copies are proportional to the bit length of the word count, up to the limit; whole copies are certain."""
    texts = [" ".join([f"t{i}", *["w"] * (0 if i % 2 else 6)]) for i in range(4000)]
    docs = documents(spark, texts, sources=["a"] * 2000 + ["b"] * 2000)
    rows = mixing.mix(docs, weights=(5, 1), seed=2).collect()
    mean = {(s, z): sum(r["copies"] for r in of) / len(of) for s in "ab" for z in (1, 7) if (of := [r for r in rows if r["source"] == s and r["size"] == z])}
    assert mean["b", 7] == pytest.approx(3 * mean["b", 1], rel=0.15)
    # source a: target 5/3 of its words; 7 * min(3, 3r) + min(3, r) = 8 * 5/3 gives r = 0.606
    assert mean["a", 7] == pytest.approx(1.818, rel=0.03) and mean["a", 1] == pytest.approx(0.606, rel=0.06)
    assert min(r["copies"] for r in rows if r["source"] == "a" and r["size"] == 7) == 1


def brute(docs, weights=(5, 2, 1), seed=17):
    """Pareto order sampling with sorted lists."""
    import hashlib
    import math

    sources = {}
    for r in docs:
        sources.setdefault(r["source"], []).append((r["doc_id"], r["text"] or "", len((r["text"] or "").split())))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = {}
    for s, target in targets({s: sum(n for *_, n in of) for s, of in sources.items()}, weights).items():
        w = [n.bit_length() for *_, n in sources[s]]
        size = [n for *_, n in sources[s]]
        rate = None
        for cut in sorted(set(w), reverse=True):  # weights above the cut are at the limit
            below = sum(a * b for a, b in zip(w, size) if a <= cut)
            if below and (r := (target - 3 * sum(b for a, b in zip(w, size) if a > cut)) / below) * cut < 3:
                rate = r
                break
        expected = [0.0 if not n else min(3.0, 3.0 if rate is None else rate * a) for a, n in zip(w, size)]
        rest = sum((e - math.floor(e)) * n for e, n in zip(expected, size))
        order = []
        for (i, t, n), e in zip(sources[s], expected):
            out[i] = math.floor(e)
            if p := e - math.floor(e):
                key = f"{seed}:{'' if i is None else i}:{md5(t)}"
                u = (int(md5(key)[:13], 16) + 0.5) / 2**52
                order.append(((u / (1 - u)) / (p / (1 - p)), i, n))
        before = 0
        for _, i, n in sorted(order):
            if before + n / 2 > rest:
                break
            out[i] += 1
            before += n
    return out


def test_copies_equal_brute_force(spark):
    docs = table(spark, seed=4)
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()} == brute(docs.collect())


def test_columns_of_any_name_stay(spark):
    docs = documents(spark, [f"w{i} x" for i in range(30)], sources=["a"] * 10 + ["b"] * 20, extra=("__id int, __source string, __copies int, __copy int, `row` string, size string, w int, u int, tie int, whole int", (1, "s", 2, 3, "r", "z", 4, 5, 6, 7)))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {(1, "s", 2, 3, "r", "z", 4, 5, 6, 7)}


def test_degenerate_tables(spark):
    assert mixing.mix(documents(spark, ["a"]).limit(0)).collect() == []
    empty = mixing.mix(documents(spark, ["", None])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in empty] == [(0, 0, 0.0)] * 2
    twice = mixing.mix(documents(spark, ["a b", "a b"], ids=[None, None])).collect()
    assert len({r["taken"] for r in twice}) == 1
    odd = documents(spark, ["w " * 300_000, "a b c", "d"], ids=[None, None, None], sources=["a", "a", "b"])
    assert sorted(r["size"] for r in mixing.mix(odd).collect()) == [1, 3, 300_000]


def test_rows_of_one_id_are_drawn_each(spark):
    """Many rows without an id: the words taken still meet the target."""
    docs = documents(spark, [f"w{i} x y" for i in range(3000)], ids=[None] * 3000, sources=["a"] * 1000 + ["b"] * 2000)
    rows = mixing.mix(docs, weights=(1, 5)).collect()
    assert abs(sum(r["taken"] for r in rows if r["source"] == "a") - 1500) <= 3
