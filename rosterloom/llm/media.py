"""Interleaved document sequences with content-addressed media.

HTML is read into an ordered sequence of structs: texts, and references to media by digest with position and caption.
Media are kept in a store keyed by the SHA-256 of their stored form; a join on the digest resolves the references, and
positions and captions stay with the reference, so the sequence is whole again in order. The query writes its store to the
shared folder and reads it again; features are computed once for each stored payload, from the bytes that are read back.
Only hashes of the texts cross a shuffle to make the store distinct: a repeated text is stored where it comes first.

A text's media form is a portable greymap (binary PGM) 24 samples wide: its UTF-8 bytes as 8-bit samples, filled up with
255, which no UTF-8 text holds, to a positive multiple of 576.

Defined results: a null text counts as empty and is stored as 576 samples of 255; equal texts have equal values; repeated
rows give a row each; references without a stored payload keep nulls; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common
from rosterloom.llm.markup import attributes, tokens

WIDTH, UNIT, FILL = 24, 576, b"\xff"
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")
_BREAKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 table tr td section article blockquote pre figure br hr".split())


def to_payload(text: str) -> bytes:
    data = text.encode()
    return data + FILL * (-len(data) % UNIT if data else UNIT)


def encode_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode_media(stored: bytes) -> bytes:
    m = _HEADER.match(stored)
    if not m or len(stored) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a stored greymap")
    return stored[m.end() :]


def feature(payload: bytes) -> str:
    """Mean, spread and the shares of sixteen grey bands in per mille, of the whole payload."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{x.mean():.3f}/{x.std():.3f}/" + ",".join(map(str, bands.tolist()))


def parse_sequence(html: str) -> list[tuple[str, str, str]]:
    """("text", text, "") and ("media", digest, caption) in page order; img sources are media:DIGEST, captions are figcaption or alt."""
    out: list[tuple[str, str, str]] = []
    parts: list[str] = []
    caption = False
    last = -1  # the reference that a caption belongs to

    def flush():
        nonlocal last
        text = " ".join("".join(parts).split())
        parts.clear()
        if not text:
            return
        if caption and last >= 0:
            out[last] = (*out[last][:2], text)
        else:
            out.append(("text", text, ""))

    for kind, name, raw in tokens(html):
        if kind == "text":
            parts.append(html_lib.unescape(name))
        elif name == "figcaption":
            flush()
            caption = kind == "open"
        elif name == "img" and kind == "open":
            flush()
            a = attributes(raw)
            source = html_lib.unescape(a.get("src", ""))
            if source.startswith("media:"):
                out.append(("media", source[6:], html_lib.unescape(a.get("alt", ""))))
                last = len(out) - 1
        elif name in _BREAKS:
            flush()
            if name == "figure":
                last = -1
    flush()
    return out


def sequences(pages: DataFrame, html: str = "html", key: str = "doc_id") -> DataFrame:
    """key, position, kind, content (a text, or the digest of a medium), caption: a row for each element, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *e) for k, h in zip(frame["k"], frame["h"], strict=True) for i, e in enumerate(parse_sequence(h or ""))]
            yield pd.DataFrame(rows, columns=["k", "position", "kind", "content", "caption"])

    common.ship(pages.sparkSession)
    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(html).alias("h"))
    out = rows.mapInPandas(run, "k string, position int, kind string, content string, caption string")
    return out.withColumn(key, F.col("k").cast(pages.schema[key].dataType)).select(key, "position", "kind", "content", "caption")


def first_texts(docs: DataFrame) -> DataFrame:
    """The distinct texts of ``docs``, a table of files as it is read, so that file and row tell the first of equal texts."""
    text, at = common.text_or_empty(), F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    keyed = docs.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("hash"), at.alias("at"))
    groups = keyed.groupBy("hash").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = common.keep(groups.filter("n > 1").select("hash", "first"), "media-repeated")
    return keyed.join(common.hinted(repeated, 48, common.BROADCAST_BYTES), "hash", "left").filter("first IS NULL OR at = first").select("text")


def encode_texts(docs: DataFrame) -> DataFrame:
    """digest and stored bytes of each text's media form."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                media = [encode_media(to_payload(t)) for t in frame["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"digest": [hashlib.sha256(m).hexdigest() for m in media], "media": media})

    common.ship(docs.sparkSession)
    return docs.select(common.text_or_empty().alias("text")).mapInPandas(run, "digest string, media binary")


def store_texts(docs: DataFrame) -> DataFrame:
    """digest and stored bytes of each distinct text's media form."""
    return encode_texts(docs).dropDuplicates(["digest"])


def read_store(store: DataFrame) -> DataFrame:
    """digest with what is computed from the stored bytes as they are read back."""
    names = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, stored in zip(frame["digest"], frame["media"], strict=True):
                stored = bytes(stored)
                payload = decode_media(stored)
                rows.append((digest, len(payload.rstrip(FILL)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in names.split(", ")])

    return store.mapInPandas(run, names)


def resolve(elements: DataFrame, store: DataFrame) -> DataFrame:
    """``elements`` (of sequences()) with the store's columns where the digest is known; texts keep nulls there."""
    media = elements.filter("kind = 'media'").join(store.withColumnRenamed("digest", "content"), "content", "left")
    texts = elements.filter("kind <> 'media'").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema if f.name != "digest"])
    return media.unionByName(texts)


def as_pages(docs: DataFrame) -> DataFrame:
    """doc_id and html: each text's lines as paragraphs, and behind them a captioned reference to its medium."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages = []
            for text in frame["text"]:
                digest = hashlib.sha256(encode_media(to_payload(text))).hexdigest()
                lines = "".join(f"<p>{html_lib.escape(x)}</p>" for x in text.split("\n"))
                pages.append(f'<article>{lines}<figure><img src="media:{digest}"><figcaption>{len(text)} characters</figcaption></figure></article>')
            yield pd.DataFrame({"doc_id": frame["doc_id"], "html": pages})

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id string, html string").withColumn("doc_id", F.col("doc_id").cast("long"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    media = sequences(as_pages(docs)).filter("kind = 'media'")
    found = resolve(media, read_store(common.keep(encode_texts(first_texts(docs)), "media-store")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
