import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rosterloom.llm import chat

PIECES = ["</s>", "[INST]", " [/INST]", "<s>", "\\", "\n", "a", " ", "<", "[", "/INST]", "</s>\n", "é", "0", "1", "]"]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_template_is_reversible_and_spans_are_exact():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, n)))
    for _ in range(1500):
        turns = [(word(4) if rnd.random() < 0.3 else rnd.choice(["user", "assistant"]), word(12)) for _ in range(rnd.randint(1, 4))]
        out, spans, rewrites = chat.render_incrementally(turns, chat.inst_template)
        parsed = chat.parse_inst(out)
        assert [(r, t) for r, t, *_ in parsed] == turns and not rewrites
        assert [s[2:] for s in spans] == [p[2:] for p in parsed]
        assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]]
        for _, text in turns:
            hidden = chat.escape(text)
            assert all(chat._odd_backslashes(hidden, m.start()) for m in re.finditer(r"</?s>|\[/?INST\]", hidden)) and chat.unescape(hidden) == text


def test_rewriting_templates_are_detected():
    last_only = lambda turns: "".join(f"[{t}]" if i == len(turns) - 1 else f"({t})" for i, (_, t) in enumerate(turns))
    counting = lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns)
    turns = [("user", "a"), ("assistant", "b")]
    assert chat.render_incrementally(turns, last_only)[2] and chat.render_incrementally(turns, counting)[2]
    assert not chat.render_incrementally(turns[:1], counting)[2]


def brute(rows):
    convs = {}
    key = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), None)
    return out


def test_digests_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, "", "hi", "</s>[INST] ok", "é🎉\\", "x" * 3000])) for c in [*range(12), None, 2**60 + 1] for t in range(rnd.randint(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(150)]  # several segments
    rows += [(7, 3, "user", "again"), (7, 3, "user", "again"), (7, None, "assistant", "first")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).repartition(5)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], None) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == brute(rows)
    many = chat.read_back(chat.format_conversations(df)).filter("conv_id = 500").first()
    assert many["n_segments"] == 5 and not many["rewrites_history"] and many["formatted_chars"] > 150 * 10


def test_templates_of_long_conversations(spark):
    """No template but a turnwise one is cut: what happens beyond SEGMENT turns is seen, and a header comes once."""
    texts = [("user", "assistant")[i % 2] for i in range(70)]
    turns = [(r, f"turn {i}") for i, r in enumerate(texts)]
    df = spark.createDataFrame([(c, i, *t) for c in (1, 2) for i, t in enumerate(turns[: 30 if c == 2 else 70])], SCHEMA).repartition(3)
    window = lambda ts: "".join(f"<{t}>" for _, t in ts[-40:])
    numbered = lambda ts: "BOS " + "".join(f"{i}:{t};" for i, (_, t) in enumerate(ts))
    for template, rewrites in ((window, True), (numbered, False)):
        got = {r["conv_id"]: r for r in chat.format_conversations(df, template).collect()}
        assert len(got) == 2 and not got[2]["rewrites_history"]
        assert (got[1]["segment"], got[1]["formatted"], got[1]["rewrites_history"]) == (0, template(turns), rewrites)
        assert got[1]["spans"][-1]["end"] == len(template(turns)) and len(got[1]["spans"]) == 70
    cut = chat.format_conversations(df).filter("conv_id = 1").orderBy("segment").collect()
    assert len(cut) == 3 and "".join(r["formatted"] for r in cut) == chat.inst_template(turns)
    numbered.turnwise = True
    with pytest.raises(Exception, match="marked turnwise"):
        chat.format_conversations(df, numbered).collect()


def test_no_rows(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_adds_the_probe(spark, sf_dir):
    got = {r["conv_id"]: r for r in chat.op2_chat(spark, sf_dir).collect()}
    probe = got[-1]
    said = "</s>[INST] ok [/INST]"
    assert (probe["n_turns"], probe["loss_chars"], probe["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(got) == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1
