"""N-gram Jaccard self-join by parity sketches.

A document's set holds its distinct word shingles. Each shingle flips one bit of a sketch, so the Hamming distance of two
sketches is at most the size of the symmetric difference of the two sets. A similarity threshold bounds that difference
for each band of set sizes, by D say; a sketch cut into more than D pieces therefore agrees with that of any similar
document on a piece. The join is on equal pieces within a band; what it finds is held against the sizes and the Hamming
distance first, and then against the shingle sets themselves, so the links are exact.

Pieces. The pieces are cut from a sketch with one bit for each 64-bit shingle hash, and a piece is stored as the XOR of
its hashes, which stands for its odd bits. (A short form of the sketch, eight bits for each difference allowed, is what
the Hamming distance is taken of.) A band has D + 1 + s pieces: similar documents agree on s + 1 of them at least, so
unless both have more than s empty pieces they agree on one that isn't empty, and empty pieces, which would agree with
too much, are left out. Documents with more than s empty pieces are cut again under another hash, and so on; the last
of ``LEVELS`` levels also joins on the empty pieces, so no link is lost.

Groups. Documents with one and the same set, known by 128 bits and its size, are linked first, and only the smallest id
goes on. In a group of documents with an equal piece each is paired with the first and with the one before it, never with
all. That is every pair in groups of three; larger groups whose documents then fall into several components go through a
second, exact round, which holds every pair of different components against sizes and sketches, block by block, and passes
on only those that may link. Components come from star contractions over kept tables; nothing is collected to the driver.
Groups are found by sorting ranges of (piece, id), and the exact round's units are pairs of blocks, so a piece that a third
of all documents share is split over tasks in both.

All texts are read once for sets, sketches and pieces, and those of the candidates again for verification. Batches to and
from Python are bounded by bytes. Broadcasts (homes of repeated sets, ids to verify and ids that go) are sent only after a
check of their size; beyond it the same joins shuffle. All kept tables but the result's go when it is written.

Defined results: A-Z is lower-cased; a text with fewer words than a shingle has its whole sequence as its one shingle; a
null text or one without words has an empty set, no link, and itself as component; rows with one id are one document,
which links by any of its texts, and each row has the shingle count of its own text; a null id stays alone with a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.llm import common

LEVELS = 6
#: At most so many rounds in which open groups meet a document of their largest component, before the exact round.
HUB_TURNS = 8
#: Texts that become Python objects at once; rows and bytes of the batches that go back to the JVM.
_SLICE, _BATCH_ROWS, _BATCH_BYTES = 64, 1000, 4 << 20
#: Documents and bytes of sketches in a block of the exact round.
_BLOCK, _BLOCK_BYTES = 1024, 8 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _Q
    x = (x ^ (x >> _U(29))) * _P
    return x ^ (x >> _U(32))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = (acc ^ w[i : i + n]) * _P
        acc ^= acc >> _U(31)
    return np.unique(mix64(acc))


class Bands:
    """Size bands for a threshold in per cent: pairs at or above it are in one band or in two neighbouring ones."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent is between 50 and 100")
        self.percent = percent
        self.lows = [1, 100 // percent + 1]

    def low(self, i: int) -> int:
        while len(self.lows) <= i:
            self.lows.append(100 * self.lows[-1] // self.percent + 1)
        return self.lows[i]

    def band(self, n: int) -> int:
        i = 0
        while self.low(i + 1) <= n:
            i += 1
        return i

    def differences(self, total: int) -> int:
        """The largest symmetric difference of two similar sets with ``total`` members between them."""
        return (100 - self.percent) * total // (100 + self.percent)

    @lru_cache(maxsize=4096)  # noqa: B019  the bands live as long as the worker
    def pieces(self, j: int) -> tuple[int, int]:
        """Pieces and slack of the joint band j: sizes of band j against those of j and j + 1."""
        a = self.low(j + 1) - 1
        most = self.differences(a + min(100 * a // self.percent, self.low(j + 2) - 1))
        if most == 0:
            return 1, 0
        n = self.low(j)
        for slack in range(1, 4 * most + 8):
            k = most + 1 + slack
            empty = k * (1 - 1 / k) ** n
            if slack >= empty + 3 * math.sqrt(empty):
                break
        return k, slack

    def sketch_longs(self, n: int) -> int:
        """64-bit words of the short sketch, a power of two."""
        return 1 << max(0, math.ceil(math.log2(max(1, self.differences(2 * n) / 8))))


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def short_sketch(h: np.ndarray, longs: int) -> np.ndarray:
    bits = np.bincount((h & _U(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def piece_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set's pieces in its two joint bands."""
    if not len(h):
        return np.empty(0, np.int64)
    b = bands(percent)
    own, out = b.band(len(h)), []
    for j in (own, own - 1) if own else (own,):
        k, slack = b.pieces(j)
        for level in range(LEVELS):
            x = h if level == 0 else np.sort(mix64(h + _U(level) * _Q))
            piece = ((x >> _U(32)) * _U(k)) >> _U(32)
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            where = piece[starts] + _U((j << 40) | (level << 32))
            out.append(mix64(np.bitwise_xor.reduceat(x, starts) ^ mix64(where + _P)))
            if k - len(starts) <= slack:
                break
            if level == LEVELS - 1:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), piece[starts])
                out.append(mix64(mix64(empty + _U((j << 40) | (level << 32)) + _P)))
    return np.concatenate(out).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes | None]]:
    """Id and text of each row; a few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _mark(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a whole set, as two signed 64-bit numbers."""
    out = []
    for seed in (_P, _Q):
        x = mix64(h ^ seed)
        both = np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(x + seed)) if len(x) else 0], np.uint64)
        out.append(int(np.bitwise_xor.reduce(mix64(both * seed + np.array([1, 2], np.uint64))).astype(np.int64)))
    return out[0], out[1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of rows of numbers and int64 arrays, closed at ``_BATCH_BYTES`` of arrays or ``_BATCH_ROWS`` rows."""
    held, size = [], 0

    def batch():
        columns = [_lists(list(c)) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        held.append(row)
        size += sum(8 * len(v) for v in row if isinstance(v, np.ndarray))
        if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_LONGS = pa.list_(pa.int64())
_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("sketch", _LONGS), ("keys", _LONGS)])
_MEMBERS = pa.schema([("doc", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("members", _LONGS)])


def _sketched(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The one pass over all texts: set size, 128-bit mark, short sketch and join keys of each row."""

    def run(batches):
        def each():
            for doc, text in _texts(batches):
                h = shingle_set(text, words)
                yield doc, len(h), *_mark(h), short_sketch(h, bands(percent).sketch_longs(len(h))), piece_keys(h, percent)

        yield from _in_batches(each(), _SKETCHED)

    return rows.mapInArrow(run, "doc_id long, n long, m1 long, m2 long, sketch array<long>, keys array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    def run(batches):
        def each():
            for doc, text in _texts(batches):
                h = shingle_set(text, words)
                yield doc, *_mark(h), h.view(np.int64)

        yield from _in_batches(each(), _MEMBERS)

    return rows.mapInArrow(run, "doc long, m1 long, m2 long, members array<long>")


def _neighbours(keyed: DataFrame) -> DataFrame:
    """key, doc, hub, prev, place of the documents that share a key (column ``key``, column ``doc``) with another.

    Keys are dealt out by ranges of (key, doc), so a key that a third of all documents have spans many tasks. Within a
    task, hub is a key's first document, prev the one before, place counts from 1. As a key may go on in the next task,
    the first document that a task has of its first and of its last key comes once more, with place 0.
    """
    names = ["key", "doc", "hub", "prev", "place"]

    def run(batches):
        carry = None  # the last row seen: key, doc, hub, place, whether it was sent
        first = last = None

        def send(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for key, doc in _joined(batches):
            k, d = (key, doc) if carry is None else (np.concatenate(([carry[0]], key)), np.concatenate(([carry[1]], doc)))
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
            k, d = k[fresh], d[fresh]
            starts = np.concatenate(([True], k[1:] != k[:-1]))
            at = np.arange(len(k))
            start = np.maximum.accumulate(np.where(starts, at, 0))
            hub, place = d[start], at - start + 1
            if carry is not None:
                of_carry = start == 0
                hub[of_carry] = carry[2]
                place[of_carry] += carry[3] - 1
            else:
                first = (k[0], d[0])
            prev = np.where(starts, d, np.concatenate((d[:1], d[:-1])))
            within = ~starts
            within[:-1] |= ~starts[1:]
            if carry is not None and carry[4]:
                within[0] = False
            carry = (k[-1], d[-1], hub[-1], place[-1], bool(within[-1]) or (len(k) == 1 and carry is not None and carry[4]))
            last = (k[-1], hub[-1])
            if within.any():
                yield send(k[within], d[within], hub[within], prev[within], place[within])
        if first is not None:
            k, d = (np.array(x) for x in zip(*{first, last}, strict=True))
            yield send(k, d, d, d, np.zeros(len(k), np.int64))

    return keyed.select("key", "doc").repartitionByRange("key", "doc").sortWithinPartitions("key", "doc").mapInArrow(run, "key long, doc long, hub long, prev long, place long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both columns of small batches, some 30,000 rows at a time."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
        if rows >= 30_000:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, rows = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b), a kept table: (doc, component) for each document but its component's smallest."""

    def kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
        table = common.keep(edges.select(F.col("hi").alias("doc"), F.col("lo").alias("component")), "edges")
        return table, tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc", "component").cast("decimal(38,0)"))).first())

    table, seen = kept(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
    while seen[0]:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = table.select(F.col("doc").alias("u"), F.col("component").alias("v")).unionByName(table.select(F.col("component").alias("u"), F.col("doc").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, before = table, seen
        table, seen = kept(moved.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        common.drop(old)
        if seen == before:
            break
    return table


def _may_link(percent: int):
    """Sizes and the Hamming distance of the short sketches allow the pair (na, sa), (nb, sb) to be similar."""
    folded = "zip_with(slice({0}, 1, CAST(size({0}) / 2 AS INT)), slice({0}, CAST(size({0}) / 2 AS INT) + 1, CAST(size({0}) / 2 AS INT)), (x, y) -> x ^ y)"
    a = f"CASE WHEN size(sa) > size(sb) THEN {folded.format('sa')} ELSE sa END"
    b = f"CASE WHEN size(sb) > size(sa) THEN {folded.format('sb')} ELSE sb END"
    distance = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(coalesce(x, 0L) ^ coalesce(y, 0L))), 0, (s, x) -> s + x)"
    return F.expr(f"CASE WHEN 100 * least(na, nb) >= {percent} * greatest(na, nb) THEN (100 + {percent}) * {distance} <= (100 - {percent}) * (na + nb) ELSE false END")


def _verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int, limit: int) -> DataFrame:
    """A kept table of those kept pairs (a, b) whose shingle sets are similar; of an id with several texts, any of them.

    The sets are kept too, so both joins deal plain scans and adaptive execution can split a document with many pairs.
    """
    scratch = common.Scratch()
    asked = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "to-verify")
    sets = _sets(rows.join(common.hinted(asked, 8, limit), "doc_id", "left_semi"), words)
    sets = scratch.keep(sets.dropDuplicates(["doc", "m1", "m2"]).select("doc", "members"), "members")
    met = pairs.join(sets.select(F.col("doc").alias("b"), F.col("members").alias("mb")), "b").join(sets.select(F.col("doc").alias("a"), F.col("members").alias("ma")), "a")
    met = met.withColumn("both", F.size(F.array_intersect("ma", "mb")))
    links = common.keep(met.filter(100 * F.col("both") >= percent * (F.size("ma") + F.size("mb") - F.col("both"))).select("a", "b").distinct(), "links")
    scratch.clear()
    return links


def _across(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within a key that sizes and sketches allow. members: key, doc, comp; facts: doc, n, sketch.

    Documents outside a key's largest component are held against all of the key's. Both sides are dealt into blocks of some
    ``_BLOCK`` documents or ``_BLOCK_BYTES`` of sketches, and each pair of blocks is a unit of its own, so a key of any size
    is spread over the cluster and a task holds two blocks. Sketches join in last: only the deal into blocks carries them.
    A pair that meets under several keys is reported for the least, so each document brings its list of keys.
    """
    sized = members.join(facts.select("doc", F.size("sketch").alias("longs")), "doc")
    by_comp = sized.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum(8 * F.col("longs")).alias("bytes"))
    of_key = by_comp.groupBy("key").agg(F.max(F.struct("size", "comp", "bytes")).alias("main"), F.sum("size").alias("rows"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / _BLOCK), F.ceil(size / _BLOCK_BYTES), F.lit(1)).cast("int")
    of_key = of_key.select(
        "key", F.col("main.comp").alias("main"), blocks(F.col("rows"), F.col("bytes")).alias("all_blocks"), blocks(F.col("rows") - F.col("main.size"), F.col("bytes") - F.col("main.bytes")).alias("own_blocks")
    )
    held = members.groupBy("doc").agg(F.sort_array(F.collect_list("key")).alias("shared"))  # as many as a document has pieces
    rows = members.join(of_key, "key").join(facts.join(held, "doc"), "doc")
    block = lambda seed, n: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["doc", "comp", "n", "sketch", "shared", (F.col("comp") == F.col("main")).alias("in_main")]
    own = rows.filter("comp <> main").select("key", block(1, "own_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(0).alias("side"), *kept)
    whole = rows.select("key", every("own_blocks").alias("i"), block(2, "all_blocks").alias("j"), F.lit(1).alias("side"), *kept)

    def stacked(sketches: list, least: int) -> np.ndarray:
        out = []
        for s in sketches:
            s = np.asarray(s, np.int64)
            while len(s) > least:
                s = s[: len(s) // 2] ^ s[len(s) // 2 :]
            out.append(s)
        return np.stack(out)

    def pairs_of(key, mine, theirs):
        (dp, cp, np_, sp, kp, _), (dq, cq, nq, sq, kq, mq) = (list(zip(*side, strict=True)) for side in (mine, theirs))
        least = min(map(len, (*sp, *sq)))
        p, q = stacked(sp, least), stacked(sq, least)
        d1, c1, n1, d2, c2, n2 = (np.array(x, np.int64) for x in (dp, cp, np_, dq, cq, nq))
        main = np.array(mq, bool)
        keys = [set(x) for x in kp]
        for a in range(len(d1)):
            ok = (c2 != c1[a]) & (main | (d2 > d1[a])) & (100 * np.minimum(n2, n1[a]) >= percent * np.maximum(n2, n1[a]))
            at = np.flatnonzero(ok)
            far = np.bitwise_count(q[at] ^ p[a]).sum(axis=1, dtype=np.int64) * (100 + percent) > (100 - percent) * (n2[at] + n1[a])
            for b in at[~far].tolist():
                if min(keys[a].intersection(kq[b])) == key:
                    yield min(dp[a], dq[b]), max(dp[a], dq[b])

    def run(batches):
        unit, sides = None, ([], [])

        def done():
            found = list(pairs_of(unit[0], *sides)) if all(sides) else []
            for at in range(0, len(found), _BATCH_ROWS):
                a, b = zip(*found[at : at + _BATCH_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, i, j, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != unit:
                    yield from done() if unit else ()
                    unit, sides = (key, i, j), ([], [])
                sides[side].append(row)
        if unit:
            yield from done()

    return own.unionByName(whole).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, *, words: int = 5, percent: int = 80, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id that links reach).

    Two documents link when their shingle sets' Jaccard similarity is at least ``percent`` / 100.
    """
    common.ship(docs.sparkSession)
    scratch = common.Scratch()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    info = scratch.keep(_sketched(rows, words, percent), "sketches")
    named = info.filter("n > 0 and doc_id is not null")
    mark = ["m1", "m2", "n"]

    # each distinct set goes on once, under its smallest id, its home
    homes = scratch.keep(named.groupBy(*mark).agg(F.min("doc_id").alias("home"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "set-homes")
    at_home = common.hinted(homes, 32, broadcast_bytes)
    placed = named.select("doc_id", *mark).join(at_home, mark, "left").select("doc_id", F.coalesce("home", "doc_id").alias("home"))
    of_id = placed.groupBy("doc_id").agg(F.min("home").alias("home"), F.max("home").alias("other")).filter("home < doc_id")
    moved = scratch.keep(of_id, "homes-of-ids")
    several = moved.filter("home < other").select("doc_id", F.col("home").alias("a"))
    by_id = scratch.keep(several.join(placed.withColumnRenamed("home", "b"), "doc_id").filter("a < b").select("a", "b").distinct(), "links-by-id")

    kept = ["doc_id", "n", "sketch", "keys"]
    once = named.join(at_home, mark).filter("doc_id = home").groupBy(*mark).agg(F.any_value(F.struct(*kept)).alias("r")).select("r.*")
    single = named.join(at_home, mark, "left_anti").select(*kept).unionByName(once)
    met = scratch.keep(_neighbours(single.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))), "equal-pieces")
    facts = scratch.keep(single.select(F.col("doc_id").alias("doc"), "n", "sketch"), "facts")

    # a key that goes on in another task: the first documents of its parts, at most two for each task
    in_key = W.partitionBy("key").orderBy("doc")
    parts_of_key = met.filter("place = 0").select("key", "doc").distinct().select("key", "doc", F.first("doc").over(in_key).alias("hub"), F.lag("doc").over(in_key).alias("prev"))
    spans = scratch.keep(parts_of_key.filter("prev is not null"), "spanning-keys")
    of = lambda x: facts.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    brought = [t.select(F.col(a).alias("a"), F.col("doc").alias("b")) for t in (met, spans) for a in ("hub", "prev")]
    tried = brought[0].unionByName(brought[1]).unionByName(brought[2]).unionByName(brought[3]).filter("a < b").distinct()
    tried = scratch.keep(tried.join(of("b"), "b").join(of("a"), "a").filter(_may_link(percent)).select("a", "b").distinct(), "pairs")
    links = _verified(tried, rows, words, percent, broadcast_bytes)
    parts = components(links.unionByName(by_id))
    common.drop(links)

    # groups of four and more: were all of their documents brought together?
    large = met.filter("place >= 4").select("key").unionByName(spans.select("key")).distinct()
    members = scratch.keep(met.join(large, "key", "left_semi").select("key", "doc").distinct(), "large-groups")

    def still_open() -> DataFrame:
        """key, doc, comp of the groups that several components share."""
        now = members.join(parts, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
        apart = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
        return scratch.keep(now.join(apart, "key", "left_semi"), "open-groups")

    def add(pairs: DataFrame) -> int:
        """Verifies the kept pairs, adds what links, and returns how many do."""
        nonlocal parts
        new, old = _verified(pairs, rows, words, percent, broadcast_bytes), parts
        if found := new.count():
            parts = components(old.select(F.col("component").alias("a"), F.col("doc").alias("b")).unionByName(new))
            common.drop(old)
        common.drop(new)
        return found

    open_ = still_open()
    for turn in range(HUB_TURNS):
        if open_.isEmpty():
            break
        # documents outside a group's largest component meet one document of it, another one each turn
        order = F.xxhash64("doc", F.lit(turn))
        by_comp = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min_by("doc", order).alias("hub"))
        main = by_comp.groupBy("key").agg(F.max(F.struct("size", "comp", "hub")).alias("m")).select("key", "m.comp", "m.hub").withColumnRenamed("comp", "main")
        meet = open_.join(main, "key").filter("comp <> main").select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")).distinct()
        meet = meet.join(tried, ["a", "b"], "left_anti").join(of("b"), "b").join(of("a"), "a").filter(_may_link(percent)).select("a", "b").distinct()
        meet = scratch.keep(meet, "pairs")
        asked = meet.count()
        found = add(meet) if asked else 0
        tried = tried.unionByName(meet)
        if found:
            open_ = still_open()
        if found * 2 < asked or not asked:
            break
    if not open_.isEmpty():
        more = scratch.keep(_across(open_, facts, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            add(more)

    out = info.select("doc_id", "n").join(moved.select("doc_id", "home"), "doc_id", "left").withColumn("home", F.coalesce("home", "doc_id"))
    out = out.join(parts.withColumnRenamed("doc", "home"), "home", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "home").alias("component_id"))
    result = common.keep(out, "components")
    scratch.clear()
    common.drop(parts)
    return result


def near_dedup(docs: DataFrame, *, words: int = 5, percent: int = 80, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component; rows of an id that stays all stay."""
    found = near_components(docs, words=words, percent=percent, broadcast_bytes=broadcast_bytes)
    gone = common.keep(found.filter("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    common.drop(found)
    return docs.join(common.hinted(gone, 8, broadcast_bytes), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(common.read(spark, sf_dir, "documents"), words=3, percent=90)
