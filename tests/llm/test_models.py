"""Toxicity and quality: held-out accuracy, what scores may depend on, and degenerate tables."""

import zlib

import pytest
from helpers import documents
from pyspark.sql import functions as F

from rosterloom.llm import quality, toxicity


def auc(rows):
    order = sorted(rows, key=lambda r: r[0])
    ranks, i = {}, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        for k in range(i, j):
            ranks[k] = (i + j - 1) / 2
        i = j
    pos = [k for k, r in enumerate(order) if r[1]]
    n1, n0 = len(pos), len(order) - len(pos)
    return (sum(ranks[k] for k in pos) - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("query,label,mod,rest,least", [(toxicity.op3_toxicity, "toxic", 5, 0, 0.9), (quality.op5_quality, "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, query, label, mod, rest, least):
    sf = "/root/testdata/sf0.1"
    got = query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert auc([(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]) >= least


def labelled(spark, texts, marks):
    return documents(spark, texts), spark.createDataFrame([(i, m, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")


def test_grammar_weighs_clauses():
    m = toxicity.Model({"scum$": 2.0, "idio": 2.0}, [1.0, 0.0, 0.0, 0.0], -2.0)
    score = lambda t: m.clauses(t)[0][2] if m.clauses(t) else 0.0
    assert score("scum") == 2 and score("You are scum") == 3 and score("he said you are scum") == pytest.approx(1.8)
    assert score("not scum") == 1 and score("not a b c scum") == 2 and score("such idiots!") == 2
    assert score("kill the lot of you") == 2 and score("kill that") == 0 and score("video of a escum") == 0
    assert [c[:2] for c in m.clauses("fine. You scum! ok\nidiot")] == [(5, 14), (19, 24)]
    assert m.features("") == m.features("all fine") == [0.0] * 4


def test_transducers_read_their_own_marks():
    """A word may be an insult and a target at once; threats count in both orders and by stem."""
    m = toxicity.Model({"scum$": 2.0, "du$": 1.0}, [1.0, 0.0, 0.0, 0.0], -2.0, {"find$": 3.0}, toxicity.Arcs(2.0, 0.5, 0.5, 1.0))
    score = lambda t: sum(c[2] for c in m.clauses(t))
    assert score("i will kill you") == score("he kills you") == score("killing you") == score("you i will kill") == 2
    assert score("i will find you") == 3 and score("find it") == 0 and score("killjoys") == 0
    assert score("du scum") == 1 + 2 * 2.0 and score("never kill you") == 1 and score("he says i will kill you") == 1
    assert score("kill a b c d you") == 0 and score("kill a b c you") == 2


def plain_score(m, text):
    """The definition, word by word: no automaton, no table."""
    import math

    marks = lambda w, table: max([table.get(w + "$", 0.0), *(table.get(w[:k], 0.0) for k in range(4, 11) if k <= len(w))])
    totals, a = [], m.arcs
    for clause in toxicity._CLAUSE_END.split(toxicity.lowered(text)):
        total, aimed, addressed, denied, told, waiting, verb = 0.0, False, False, 0, False, 0, 0.0
        for w in toxicity._WORD.findall(clause):
            threat = marks(w, m.threats) or (2.0 if any(w.startswith(x) and len(w) <= len(x) + 3 for x in toxicity.THREAT_STEMS) else 0.0)
            verb = threat or verb
            scale = (a.denied if denied else 1) * (a.told if told else 1)
            total += marks(w, m.lexicon) * scale * (a.aimed if aimed else 1)
            target, done = w in toxicity.TARGETS, False
            if (threat and addressed) or (waiting and target):
                total, done = total + verb * scale * a.threat, True
            waiting = 0 if done else 4 if threat else max(0, waiting - 1)
            denied = 3 if w in toxicity.NEGATIONS else max(0, denied - 1)
            told, aimed, addressed = told or w in toxicity.REPORTS, aimed or target, addressed or w in toxicity.ADDRESSED
        totals.append(total)
    totals = [t for t in totals if t]
    x = [math.log1p(max(totals)), math.log1p(sum(totals)), math.log1p(len(totals)), math.log1p(1000 * sum(totals) / len(text))] if totals else [0.0] * 4
    return 1 / (1 + math.exp(-(m.bias + sum(p * q for p, q in zip(m.weights, x, strict=True)))))


def test_toxicity_equals_brute_force(spark):
    import random

    rnd = random.Random(6)
    m = toxicity.Model({"scum$": 2.0, "idio": 1.5, "you$": 0.25}, [0.7, 0.3, -0.2, 0.1], -1.0, {"find$": 3.0, "smash": 1.0}, toxicity.Arcs(1.5, 0.25, 0.6, 2.0))
    words = "You he scum IDIOTS idio not never said KILL killing killers find smashes them İx a b plain don't über du ß".split()
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", ". ", "!", "\n", "; "]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, [*texts, None, ""]), m).collect()}
    assert len({round(r["score"], 6) for r in got.values()}) > 200
    for i, t in enumerate([*texts, "", ""]):
        assert got[i]["score"] == pytest.approx(plain_score(m, t), abs=1e-12), t
        if got[i]["worst_start"] is not None:
            assert 0 <= got[i]["worst_start"] < got[i]["worst_end"] <= len(t)


def test_long_texts_take_time_in_proportion():
    import time

    m = toxicity.Model({"scum$": 2.0}, [1.0, 0.0, 0.0, 0.0], -2.0)
    began = time.monotonic()
    for text in ("scum and plain words, " * 250_000, "scum. " * 800_000, "x " * 2_500_000):
        m.features(text)
    assert time.monotonic() - began < 60


def test_threats_and_arcs_are_learned(spark):
    """A verb that toxic texts aim at somebody is a threat, not an insult; what is denied counts for nothing where labels say so."""
    texts, marks = [], []
    for i in range(600):
        kind = i % 6 if i % 6 != 4 or i % 30 == 4 else 0
        texts.append([f"plain a{i} words what i will", "i will frobble you", "they frobble wood here", "what scum", "what is not scum", f"more b{i} text"][kind])
        marks.append(int(kind in (1, 3)))
    docs, labels = labelled(spark, texts, marks)
    model = toxicity.fit(docs, labels, held_out=lambda c: F.lit(False))
    assert any(k.startswith("frob") for k in model.threats) and not any(k.startswith("frob") for k in model.lexicon)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == marks[i] for i in range(600)) >= 590 and model.arcs.denied < 0.5


def test_discriminant_equals_brute_force(spark):
    import math
    import random

    import numpy as np

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["Plain", "word", "12", "$$", "!", "long-winded", "a"][: 4 + 3 * (i % 2)]) for _ in range(rnd.randint(3, 60))) for i in range(300)]
    docs, labels = labelled(spark, texts, [i % 2 for i in range(300)])
    x = quality.vectors(docs)
    model = quality.fit(x, labels, "quality", quality.held_out_3)
    v = np.array([quality.statistics(t) for t in texts])
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    centre, scale = v[train].mean(0), np.sqrt(np.maximum((v[train] ** 2).mean(0) - v[train].mean(0) ** 2, 1e-6))
    z = np.clip((v - centre) / scale, -6, 6)
    of = [[i for i in train if i % 2 == c] for c in (0, 1)]
    cov = [np.cov(z[k].T, bias=True) for k in of]
    pooled, d, logs = sum(len(k) * c for k, c in zip(of, cov)) / len(train), z.shape[1], []
    for k, c in zip(of, cov):
        a = 0.1 + 0.9 * d / (d + len(k))
        s = (1 - a) * c + a * pooled
        s = 0.95 * s + 0.05 * max(np.trace(s) / d, 1e-3) * np.eye(d)
        e = z - z[k].mean(0)
        logs.append(math.log(len(k) / len(train)) - 0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) + np.linalg.slogdet(s)[1]))
    want = 1 / (1 + np.exp(-0.5 * (logs[1] - logs[0])))
    got = {r["doc_id"]: r["score"] for r in quality.score(x, model).collect()}
    assert max(abs(got[i] - want[i]) for i in range(300)) < 1e-6


def test_learned_lexicon_is_used(spark):
    texts = [f"word{i} plain text number {i}" + (" grumble wretched" if i % 3 == 0 else "") for i in range(240)]
    docs, labels = labelled(spark, [*texts, None, ""], [int(i % 3 == 0) for i in range(240)])
    model = toxicity.fit(docs, labels)
    assert {"wretched$", "grumble$"} <= set(model.lexicon)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(240)) and got[240]["predicted"] == got[241]["predicted"] == 0 and got[0]["n_clauses"] == 1
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(242) if i >= 240 or i % 3]


def test_texts_without_words_train_too(spark):
    docs, labels = labelled(spark, ["1 2 3", "", None, "..."] * 20, [i % 2 for i in range(80)])
    model = toxicity.fit(docs, labels)
    assert not model.lexicon and len({r["score"] for r in toxicity.score(docs, model).collect()}) == 1


@pytest.mark.parametrize("marks", [[], [1] * 40, [0] * 40])
def test_one_class_or_none(spark, marks):
    docs, labels = labelled(spark, [f"text {i}" for i in range(40)] + [None], marks)
    model = toxicity.fit(docs, labels)
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {int(bool(marks and marks[0]))}
    x = quality.vectors(docs)
    d = quality.fit(x, labels, "quality", quality.held_out_3)
    assert {r["predicted"] for r in quality.score(x, d).collect()} == {int(bool(marks and marks[0]))}


def test_rows_without_id_keep_large_ids_whole(spark):
    big = 2**60 + 1
    docs, labels = labelled(spark, ["a scum", "b"] * 30, [1, 0] * 30)
    odd = documents(spark, ["a scum", None, ""], ids=[big, None, big])
    model = toxicity.fit(docs, labels)
    assert sorted((r["doc_id"] or 0) for r in toxicity.score(odd, model).collect()) == [0, big, big]
    assert sorted((r["doc_id"] or 0) for r in quality.vectors(odd).collect()) == [0, big, big]
    kept = toxicity.not_toxic(odd.withColumn("n_chars", F.lit(None).cast("long")), labels)
    assert kept.columns == odd.columns and {r["n_chars"] for r in kept.collect()} <= {None}


def test_statistics_of_odd_texts(spark):
    for t in ("", " ", "\n", "é" * 10, "x" * 200_000, "a\n" * 500, "🎉"):
        v = quality.statistics(t)
        assert len(v) == len(quality.FEATURES) and all(abs(x) < 100 for x in v)
    docs = documents(spark, ["a", None], ids=[1, 1], extra=("score double, x int", (0.5, 1)))
    assert quality.vectors(docs).count() == 2 and quality.vectors(docs.limit(0)).collect() == []


def test_lang_source_and_id_do_not_matter(spark):
    docs, labels = labelled(spark, [("GOOD plain prose. " if i % 2 else "$$$ ### !!! ") * (1 + i % 5) for i in range(60)], [i % 2 for i in range(60)])
    x = quality.vectors(docs)
    d = quality.fit(x, labels, "quality", quality.held_out_3)
    other = docs.withColumns({"doc_id": F.col("doc_id") + 1000, "lang": F.lit("zz"), "source": F.lit("q")})
    a = {r["doc_id"]: r["score"] for r in quality.score(x, d).collect()}
    b = {r["doc_id"] - 1000: r["score"] for r in quality.score(quality.vectors(other), d).collect()}
    assert a == b and all((a[i] >= 0.5) == bool(i % 2) for i in a)
