import random
import zlib

import numpy as np
import pytest
from helpers import documents
from tokenizers import Tokenizer

from rosterloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity

PATH = packing.default_tokenizer()
ODD = [
    "I'm it's we'll 12 3a a_b <|endoftext|> x<|startoftext|>y Á é ὈΔΥΣΣΕΎΣ İstanbul ǅ ß ﬁ Å 日本語 \x1c x\x1dy a\x85b a b  x　y z 1²³ ½ don'T 'S", "", " ", "\x1f", "...'s,,'re", "á̧b", "'",
    "ſ's K Å", "x\x00y", "힣가", "𝔘𝔫 🎉🎉'd 🎉s", "<|ENDOFTEXT|>", None,
]


def plain(text):
    return np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_cached_ids_equal_the_tokenizers(monkeypatch):
    rnd = random.Random(1)
    alphabet = "aB'sdt.,! \t\n1é<|>endoftxİ́ß²’_-"
    texts = [t for t in ODD if t is not None] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.ChunkEncoder(PATH).encode(texts) == want
    monkeypatch.setattr(packing, "CACHE", 50)  # caches that start anew all the time
    small = packing.ChunkEncoder(PATH)
    assert [small.encode([t])[0] for t in texts[:400]] == want[:400]


def test_long_chunks_are_not_cached():
    texts = ["x" * 100_000 + " short", "y1" * 5000 + "., " + "z" * 65, "short " + "z" * 65, "É" * 70 + "'s"]
    coder = packing.ChunkEncoder(PATH)
    assert coder.encode(texts) == [plain(t) for t in texts] == [coder.encode([t])[0] for t in texts]
    assert max(map(len, (*coder.chunks, *coder.pieces))) <= packing.LONG


def test_only_unseen_pieces_reach_the_model(monkeypatch):
    """Words that were met come again with other marks around them."""
    coder = packing.ChunkEncoder(PATH)
    coder.encode(["alpha beta it's gamma"])
    reached, learn = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda unseen: reached.extend(unseen) or learn(unseen))
    texts = ["Alpha.### beta***\n(gamma),", "alpha###BETA's alpha.### 'it,"]
    assert coder.encode(texts) == [plain(t) for t in texts]
    assert sorted(reached) == sorted([".###", "***", "(", "),", "###", "'", ","])


@pytest.mark.parametrize("size", [1, 7, 64])
def test_texts_of_several_blocks(monkeypatch, size):
    monkeypatch.setattr(packing, "BLOCK", size)
    texts = [t for t in ODD if t is not None] * 2 + ["don't we'llx '''s 've'd'q re's ²½. 'Tis日本's é.É ", "x" * 200 + " 's" * 50]
    coder = packing.ChunkEncoder(PATH)
    assert coder.encode(texts) == [plain(t) for t in texts]
    assert coder.block(["", " \n", "a b"]) == [b"", b"", plain("a b")]


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12_345])
def test_pieces(n):
    p = packing.power_pieces(n, 4096)
    assert sum(p) == n and all(x <= 4096 and x & (x - 1) == 0 for x in p) and p == sorted(p, reverse=True)


def test_pack_round_trip(spark):
    texts = [*ODD, "word " * 9000, "same", "same"]
    docs = documents(spark, texts, extra=("length int, bucket string", (1, "b")))
    rows = packing.pack(docs, PATH).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = plain(t or "") + np.array([2], "<u4").tobytes()
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["offset"] == 0 and r["doc_tokens"] == len(ids) // 4 and r["length"] == 1 << r["bucket"] <= 4096
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, max_len=1000)


def test_pipeline_equals_its_stages(spark, sf_dir):
    """Each stage against a brute-force version on what its predecessor kept."""
    import corpus_pipeline as cp
    from test_exact_dedup import brute as exact_brute
    from test_ngram_join import brute as near_brute

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, seen = source, {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = cp.common.keep(stage(spark, docs, sf_dir), "test-stage")
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == source.columns
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    before, after = seen["toxicity"]
    model = toxicity.fit(source, labels)
    assert ids(after) == sorted(r["doc_id"] for r in before if model.score(model.features(r["text"] or "")) < 0.5)
    before, after = seen["exact dedup"]
    assert ids(after) == sorted(i for i, _, _, kept, _ in exact_brute([(r["doc_id"], r["text"]) for r in before], max) if kept)
    before, after = seen["n-gram Jaccard join"]
    near = near_brute([r["text"] for r in before], [r["doc_id"] for r in before], 5, 80)
    assert ids(after) == sorted(i for i, (_, c) in near.items() if i == c)
    before, after = seen["mixing sources to target weights"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(before, source.schema)).collect()}
    assert ids(after) == sorted(i for i, c in copies.items() for _ in range(c))
    before, after = seen["packing"]
    assert sum(r["length"] for r in after) == sum(len(plain(r["text"] or "")) // 4 + 1 for r in before)
    assert exact_dedup and ngram_join
