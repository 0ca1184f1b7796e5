"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to a string, and nothing else is known of it. The turns of a conversation
are rendered as successive prefixes; where an output begins with the one before it, what it adds is the newest turn's
span, and where it doesn't, the template rewrites history and the conversation is marked so, with the span starting at
the first change. Inside its span, a turn's text stands where the output changes with the text: the prefix is rendered
with two one-letter texts, and what these outputs have in common before and behind the letter frames the text.

Rendering every prefix is quadratic, and a template of which nothing is known gets no less: its conversations are held and
rendered whole, each in one segment. A template marked ``turnwise``, whose output is that of each turn by itself, one after
the other, as ``inst_template``'s is, has long conversations rendered in segments of at most ``SEGMENT`` turns whose outputs
follow each other; each boundary is rendered too, and a template that isn't turnwise there is an error. Rows stream through a
worker sorted by conversation and turn; with segments it holds two at a time, whatever the length of a conversation.

Defined results: turns are ordered by turn (null first), then role, then text; repeated rows are turns each; a null text
or role is empty; a null conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common

SEGMENT = 32
SEGMENT_CHARS = 1 << 20
Turn = tuple[str, str]

# The template's control strings.
OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>\n"
_CONTROL = re.compile(r"\\|(?=</?s>|\[/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash and each control string; ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def inst_template(turns: list[Turn]) -> str:
    """<s>[INST] role, a line feed, text [/INST]</s>, with line feeds of a role escaped too."""
    return "".join(f"{OPEN}{_role(r)}\n{escape(t)}{CLOSE}" for r, t in turns)


inst_template.turnwise = True


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def parse_inst(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text and the bounds of the escaped text for each turn of ``inst_template``'s output."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        stop = at + len(OPEN)
        while (stop := formatted.index("\n", stop)) and _odd_backslashes(formatted, stop):
            stop += 1
        end = stop
        while (end := formatted.index(CLOSE, end)) and _odd_backslashes(formatted, end + 1):
            end += 1
        out.append((unescape(formatted[at + len(OPEN) : stop]), unescape(formatted[stop + 1 : end]), stop + 1, end))
        at = end + len(CLOSE)
    return out


def _odd_backslashes(s: str, at: int) -> bool:
    k = at
    while k and s[k - 1] == "\\":
        k -= 1
    return (at - k) % 2 == 1


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def render_incrementally(turns: list[Turn], template: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The whole output; for each turn (span start, span end, text start, text end); whether history is rewritten."""
    spans, before, rewrites = [], "", False
    for k, (role, _text) in enumerate(turns):
        now = template(turns[: k + 1])
        start = len(before) if now.startswith(before) else _common(before, now)
        rewrites |= start < len(before)
        zero, one = (template([*turns[:k], (role, probe)]) for probe in "01")
        text_start, tail = _common(zero, one), _common(zero[::-1], one[::-1])
        text_end = len(now) - tail
        spans.append((start, len(now), text_start, text_end))
        before = now
    return before, spans, rewrites


def _segments(frames: Iterator[pd.DataFrame], cut: bool) -> Iterator[tuple[object, int, list[Turn]]]:
    """(conv_id, number, turns) of sorted rows; with ``cut`` each has at most SEGMENT turns and about SEGMENT_CHARS characters."""
    conv, number, turns, chars = None, 0, [], 0
    for frame in frames:
        for c, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
            same = turns and c == conv
            if turns and (not same or cut and (len(turns) >= SEGMENT or chars + len(text) > SEGMENT_CHARS)):
                yield conv, number, turns
                number, turns, chars = (number + 1 if same else 0), [], 0
            conv = c
            turns.append((role, text))
            chars += len(text)
    if turns:
        yield conv, number, turns


def _check_boundary(before: list[Turn], turns: list[Turn], template: Callable[[list[Turn]], str]) -> None:
    if template([*before, turns[0]]) != template(before) + template(turns[:1]):
        raise ValueError("the template is marked turnwise, but a turn's output depends on the turns before it")


def _id(conv: str | None):
    """Ids travel as strings, for a null would turn a column of integers into floats."""
    return pd.array([None if conv is None else int(conv)], "Int64")


_FORMATTED = "conv_id long, segment long, formatted string, rewrites_history boolean, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>"


def format_conversations(conversations: DataFrame, template: Callable[[list[Turn]], str] = inst_template) -> DataFrame:
    """conv_id, segment, formatted, rewrites_history and the turns' spans; the rows of a conversation come together, in order.

    A conversation has one row, or with a turnwise template a row for each segment, with spans from the segment's start.
    """
    turnwise = getattr(template, "turnwise", False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: list[Turn] = []
        for conv, number, turns in _segments(frames, turnwise):
            if number:
                _check_boundary(before, turns, template)
            before = turns
            text, spans, rewrites = render_incrementally(turns, template)
            found = [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d} for (r, _), (a, b, c, d) in zip(turns, spans, strict=True)]
            yield pd.DataFrame({"conv_id": _id(conv), "segment": [number], "formatted": [text], "rewrites_history": [rewrites], "spans": [found]})

    common.ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), common.text_or_empty().alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInPandas(run, _FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted strings and the spans of assistant texts alone: the contract's digests."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_segments long, rewrites_history boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def out():
            conv, n, turns, chars, loss, total, segments, rewrites = state
            row = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, segments, rewrites]
            frame = pd.DataFrame([row], columns=[x.split()[0] for x in names.split(", ")])
            frame["conv_id"] = _id(conv)
            return frame

        for frame in frames:
            for conv, number, text, rewrites, spans in zip(frame["conv_id"], frame["segment"], frame["formatted"], frame["rewrites_history"], frame["spans"], strict=True):
                if number == 0:
                    if state:
                        yield out()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, False]
                for role, said, *_ in parse_inst(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    if s["role"] == "assistant":
                        said = unescape(text[s["text_start"] : s["text_end"]])
                        state[3] += len(said)
                        state[4].update(said.encode())
                state[5] += len(text)
                state[6] += 1
                state[7] |= bool(rewrites)
        if state:
            yield out()

    return formatted.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, names)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)", {"said": said})
    rows = common.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_conversations(rows.unionByName(probe))).drop("n_segments")
