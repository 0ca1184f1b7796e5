"""Packing by power-of-two decomposition.

A document's token ids (with the end id) are cut into pieces of ``max_len`` and, for the rest, one piece for each binary
digit of its length, longest first. Every piece is a sequence of its own at a power of two, so nothing is padded and no
sequence crosses documents; ``bucket`` (the exponent) tells which pieces have equal length and can share a batch.

The tokenizer lower-cases, drops white space and splits the rest into pieces that no token crosses, so a text's ids are those
of its pieces in turn. Many texts are split at once on arrays of code points, Arrow numbers the block's distinct pieces, and
each Python worker keeps the ids of the pieces it has seen as bytes; only unseen pieces reach the tokenizer's model. When a
cache reaches ``CACHE`` entries, the half met last goes, and what is longer than ``LONG`` characters isn't cached, so memory
stays bounded whatever texts are made of.

Defined results: a null or empty text is the end id alone, one piece of length 1; repeated rows are packed each; an empty
table gives an empty result; other columns, of whatever name, are ignored. sequence_id numbers the pieces as the scan meets them, the same whenever a task is rerun.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common

CACHE = 300_000
#: Characters of a chunk that is cached at most; longer ones (base64, addresses) hardly repeat.
LONG = 64
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int"
#: What a text may hold that its chunks, looked up one by one, would not show; such texts go to the tokenizer whole.
_WHOLE = ("<|startoftext|>", "<|endoftext|>", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: Beyond these letters, case and composition depend on more than one letter; such chunks go to the tokenizer as they are.
_FURTHER = regex.compile(r"[^\x00-\u0130\u0132-\u0148\u014A-\u0177\u2010-\u2027]")
#: Characters that are split at once, about; a longer text is cut at white space.
BLOCK = 1 << 20
_BLANK = re.compile(r"\s")
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _kind(c: str) -> int:
    if _FURTHER.match(c):
        return _OTHER
    return _SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if unicodedata.category(c)[0] == "N" else _MARK


#: The kind of each code point; the last entry stands for all that follow.
_KINDS = np.array([_kind(chr(i)) for i in range(0x2029)], dtype=np.uint8)
_LOADED: dict[str, "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """What byte-level models read instead of a character: a printable one for each of its UTF-8 bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [i for i in range(256) if i not in printable]
    byte = {i: chr(i) for i in printable} | {i: chr(256 + k) for k, i in enumerate(others)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(len(_KINDS) - 1)}


_BYTE_LETTERS = _byte_letters()


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK and (space := _BLANK.search(text, at + BLOCK)):
        yield text[at : space.start()]
        at = space.end()
    yield text[at:] if at else text


def _starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marks the code points at which the tokenizer's own split begins a piece.

    The split is ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``; a chunk that holds characters of ``_FURTHER`` stays
    one piece. The last code point is white space.
    """
    starts = kinds == _DIGIT
    starts[1:] |= kinds[1:] != kinds[:-1]
    starts[0] = True
    starts &= kinds != _SPACE
    quotes = np.flatnonzero(starts & (codes == ord("'")))
    for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
        at = quotes[quotes + len(ending) < len(codes)]
        for k, c in enumerate(ending, 1):
            at = at[codes[at + k] == ord(c)]
        starts[at + 1] = False
        at = at + len(ending) + 1
        starts[at] = kinds[at] != _SPACE
    further = np.flatnonzero(kinds == _OTHER)
    if len(further):
        first = kinds != _SPACE
        first[1:] &= kinds[:-1] == _SPACE
        chunk = np.cumsum(first)
        held = np.zeros(chunk[-1] + 1, dtype=bool)
        held[chunk[further]] = True
        inside = held[chunk]
        starts[inside] = first[inside]
    return starts


def _thin(cache: dict) -> None:
    """Keeps the half that was met first: frequent chunks come early."""
    kept = dict(islice(cache.items(), CACHE // 2))
    cache.clear()
    cache.update(kept)


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with bounded caches of pieces and of ``_FURTHER`` chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The bare merges, for pieces that are split and lower-cased already.
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, unseen: list[str]) -> list[bytes]:
        """Ids of pieces that are split and lower-cased."""
        tokenize = self.model.tokenize
        ids: list[int] = []
        stops = [0]
        for p in unseen:
            ids += [t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.translate(_BYTE_LETTERS))]
            stops.append(4 * len(ids))
        data = np.array(ids, dtype="<u4").tobytes()
        return list(map(data.__getitem__, map(slice, stops, stops[1:])))

    def look_up(self, listed: list[str]) -> list[bytes]:
        """Ids of distinct pieces and chunks; all but the long ones go into the caches."""
        out = list(map(self.pieces.get, listed))
        unseen: list[int] = []
        for i in [i for i, v in enumerate(out) if v is None]:
            p = listed[i]
            if p.isascii() or not _FURTHER.search(p):
                unseen.append(i)
            elif (v := self.chunks.get(p)) is not None:
                out[i] = v
            else:
                out[i] = self.plain(p)
                if len(p) <= LONG:
                    if len(self.chunks) >= CACHE:
                        _thin(self.chunks)
                    self.chunks[p] = out[i]
        if len(self.pieces) + len(unseen) > CACHE:
            _thin(self.pieces)
        for i, v in zip(unseen, self.learn([listed[i] for i in unseen]), strict=True):
            out[i] = v
            if len(listed[i]) <= LONG:
                self.pieces[listed[i]] = v
        return out

    def block(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased texts whose pieces are found together."""
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype="<u4")
        kinds = _KINDS.take(codes, mode="clip")
        starts = _starts(codes, kinds)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        counts = np.searchsorted(np.flatnonzero(starts), bounds)
        solid = kinds != _SPACE
        codes, starts = codes[solid], starts[solid]
        if not len(codes):
            return [b""] * len(texts)
        offsets = np.append(np.flatnonzero(starts), len(codes))
        if codes.max() < 0x80:
            data = codes.astype(np.uint8).tobytes()
        else:
            wide = np.cumsum((codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)
            offsets += np.append(0, wide)[offsets]
            data = codes.tobytes().decode("utf-32-le").encode()
        found = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        values = self.look_up(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = found.indices.to_numpy()
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(values), dtype="<u4")[np.repeat(begins[which] - ends + n, n) + np.arange(ends[-1])]
        cuts = np.append(0, ends)[np.append(0, counts)].tolist()
        return [ids[a:b].tobytes() for a, b in pairwise(cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        some: list[tuple[int, str]] = []
        size = 0

        def finish() -> None:
            for (i, _), ids in zip(some, self.block([t for _, t in some]), strict=True):
                out[i].append(ids)
            some.clear()

        for i, text in enumerate(texts):
            if any(s in text for s in _WHOLE):
                out[i].append(self.plain(text))
                continue
            if text.isascii() or not _FURTHER.search(text):
                text = text.lower()
            else:
                text = " ".join([w if _FURTHER.search(w) else w.lower() for w in text.split()])
            for part in _parts(text):
                some.append((i, part))
                size += len(part)
                if size >= BLOCK:
                    finish()
                    size = 0
        if some:
            finish()
        return [b"".join(parts) for parts in out]


def encoder(path: str) -> ChunkEncoder:
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def power_pieces(n: int, max_len: int) -> list[int]:
    """n as max_len + max_len + ... + descending powers of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, max_len: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket."""
    if max_len & (max_len - 1):
        raise ValueError("max_len is a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for n in power_pieces(total, max_len):
                        rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, 0, n.bit_length() - 1))
                        start += n
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 6 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    common.ship(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"), default_tokenizer())
