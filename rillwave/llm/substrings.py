"""Removal of repeated substrings by longest-previous-factor arrays over partitioned suffixes.

A byte goes if it lies in a `LENGTH`-byte string that also starts earlier. Every such string has a minimizer: the first
of the least by hash among its `GRAM`-byte grams. Equal strings have equal minimizers at the same offset, so suffixes are
partitioned by minimizer: neighbouring strings whose minimizer stands at one place are a piece, and pieces with different
minimizers share nothing.

1. Each task cuts its documents into pieces and keeps only hashes. Pieces it has seen before are covered; the rest go,
   packed, to a bucket of their minimizer.
2. A bucket covers all but the earliest of equal pieces and asks for the bytes of those that share one side with another
   one: the minimizer with the `SIDE` bytes before or behind it, as a string two pieces share has one of these.
3. Those bytes are put in suffix order (rank doubling, cut at LENGTH bytes). The previous and the next smaller text
   position in that order are the only candidates for a longest earlier match; where one of them agrees on LENGTH bytes
   the string is a later copy. A minimizer with more than `PIECES` of these pieces is divided by its strings' hashes;
   of such a string only a digest travels.
4. Covered ranges meet their documents again.

Documents are dealt to parts by doc_id. Ranges and requests go to their part packed, in a few bytes each, since there may
be one for every piece.

A piece has at most SPAN strings. In periodic text pieces are short, but equal to the one before, so their task covers
them; grams of one byte repeated are minimizers only where there is no other, as filling of any width is common.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; positions are ordered by doc_id (null last),
then text, then start, so of identical rows one is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwave.llm.common import table
from rillwave.llm.shingles import _powers, mixed

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
#: Bytes hashed at once, pieces a task packs at once, asked pieces of a minimizer that one group compares.
CHUNK, PACK, PIECES = 1 << 20, 1 << 19, 20_000
#: Bytes of text per bucket, and at most per part.
BUCKET_BYTES = 16 << 20
PART_BYTES = 8 << 20
#: Bytes of pieces put in suffix order at once.
SORTED_BYTES = 2 << 20
#: Bytes of the digest of a string.
DIGEST = 16
#: Low bits of a gram's rank: its place in a chunk.
_PLACE = np.uint64((1 << (CHUNK + LENGTH).bit_length()) - 1)

_PACKED = "bucket int, h binary, c binary, sides binary, k binary, copy binary, start binary, size binary"
_FOUND = "part int, ranges binary, h binary, groups binary"
_BYTES = {"h": "<i8", "k": "<i8", "copy": "<i4", "start": "<i8", "size": "<i4"}


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` neighbours."""
    n = len(x) - span + 1
    padded = np.concatenate([x, np.full(-len(x) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[span - 1:span - 1 + n])


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, content hash, start, size in bytes, and hashes of both sides (0: not within), of a text's pieces."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    changes = np.zeros(n, np.int32)
    np.cumsum(raw[1:] != raw[:-1], out=changes[1:])
    rank = grams | _PLACE
    rank[changes[GRAM - 1:] == changes[:n - GRAM + 1]] = np.iinfo(np.uint64).max
    least = _least(rank ^ _PLACE | np.arange(len(grams), dtype=np.uint64), SPAN)
    edge = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    at = (least[edge] & _PLACE).astype(np.int64)
    size = np.diff(np.append(edge, len(least))) + LENGTH - 1

    def hashed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    before, behind = at - SIDE >= edge, at + GRAM + SIDE <= edge + size
    left = np.where(before, hashed(np.where(before, at - SIDE, 0), at + GRAM) >> np.uint64(32) | np.uint64(1), np.uint64(0))
    right = np.where(behind, hashed(at, np.where(behind, at + GRAM + SIDE, n)) >> np.uint64(32) | np.uint64(1), np.uint64(0))
    return grams[at], hashed(edge, edge + size), edge, size, left << np.uint64(32) | right


def _text_pieces(raw: bytes) -> Iterator[tuple]:
    """Pieces of a text of any length: cut into overlapping chunks, so that each string belongs to one of them."""
    for at in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
        h, c, start, size, sides = pieces(np.frombuffer(raw, np.uint8, min(CHUNK + LENGTH - 1, len(raw) - at), at))
        yield h, c, start + at, size, sides


def _planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, the first of each before the second of each: those that vary little pack well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw: list[bytes], kind: str) -> np.ndarray:
    """The numbers of some _planes."""
    width = np.dtype(kind).itemsize
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, np.uint8).reshape(width, -1).T.copy().view(kind)[:, 0] for x in raw)])


def _part(k: np.ndarray, parts: int) -> np.ndarray:
    """Spark's pmod(hash(k), parts)."""
    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return x << np.uint32(bits) | x >> np.uint32(32 - bits)

    h = np.full(len(k), 42, np.uint32)
    for word in np.ascontiguousarray(k, "<i8").view("<u4").reshape(-1, 2).T:
        h ^= turned(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return h.view(np.int32).astype(np.int64) % parts


def _dealt(parts: int, k, copy, start, stop, h=None, groups=None) -> pa.Table:
    """Ranges, or requests with their minimizers, packed by part."""
    part = _part(k, parts)
    order = np.lexsort((start, copy, part))
    part, numbers = part[order], np.stack([copy, start, stop - start]).astype("<i4")[:, order]
    edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    cut = [*zip(edge[:-1], edge[1:])] if len(part) else []
    ranges = [b"".join(_planes(x[lo:hi]) for x in numbers) for lo, hi in cut]
    extra = [[b""] * len(cut)] * 2 if h is None else [[_planes(x[order][lo:hi]) for lo, hi in cut] for x in (h, groups)]
    return pa.table([pa.array([int(part[lo]) for lo, _ in cut], pa.int32()), *(pa.array(x, pa.binary()) for x in (ranges, *extra))],
                    names=["part", "ranges", "h", "groups"])


def _undealt(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """copy, start and size of packed ranges."""
    each = [np.frombuffer(x, np.uint8).reshape(3, 4, -1).transpose(0, 2, 1).copy().view("<i4")[:, :, 0] for x in rows["ranges"].to_pylist()]
    return tuple(np.concatenate([np.zeros((3, 0), "<i4"), *each], axis=1).astype(np.int64))


def _ranges(k, copy, start, stop) -> tuple[np.ndarray, ...]:
    """Unions of ranges that come in order of (k, copy, start, stop)."""
    if not len(k):
        return k, copy, start, stop
    new = np.append(True, (k[1:] != k[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > stop[:-1]))
    first = np.flatnonzero(new)
    return k[first], copy[first], start[first], np.maximum.reduceat(stop, first)


def _pack(buckets: int):
    """Task side of step 1."""
    schema = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("h", "c", "sides", "k", "copy", "start", "size")])

    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, c, sides, k, copy, start, size = (np.concatenate(x) for x in zip(*parts))
        same = mixed(h + mixed(c))
        order = np.argsort(same, kind="stable")                       # rows come in text order
        later = np.zeros(len(h), bool)
        later[order[1:]] = same[order[1:]] == same[order[:-1]]
        rows = []
        if later.any():
            ck, cc, cs, ce = _ranges(k[later], copy[later], start[later], (start + size)[later])
            rows.append((int(ck[0] % buckets), b"", b"", b"", _planes(ck), _planes(cc), _planes(cs), _planes(ce - cs)))
        keep = np.flatnonzero(~later)
        bucket = (h[keep] % np.uint64(buckets)).astype(np.int64)
        keep = keep[np.argsort(bucket, kind="stable")]
        for part in np.split(keep, np.searchsorted(np.sort(bucket), np.arange(1, buckets))):
            if len(part):
                rows.append((int(h[part[0]] % np.uint64(buckets)), h[part].tobytes(), c[part].tobytes(), sides[part].tobytes(),
                             _planes(k[part]), _planes(copy[part]), _planes(start[part]), size[part].astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for k, copy, raw in zip(*(batch[c].to_pylist() for c in ("k", "copy", "raw"))):
                for h, c, start, size, sides in _text_pieces(raw):
                    if len(h):
                        parts.append((h, c, sides, np.full(len(h), k, np.int64), np.full(len(h), copy, np.int32), start, size))
                        held += len(h)
                    if held >= PACK:
                        yield from emit(parts)
                        parts, held = [], 0
        if parts:
            yield from emit(parts)
    return run


def _shared(h: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another element has the same h and side; side 0 is none."""
    order = np.lexsort((side, h))
    twice = (h[order[1:]] == h[order[:-1]]) & (side[order[1:]] == side[order[:-1]]) & (side[order[1:]] > 0)
    out = np.zeros(len(h), bool)
    out[order[1:][twice]] = out[order[:-1][twice]] = True
    return out


def _settle(parts: int):
    """Step 2 for one bucket: covered ranges (h empty) and requests for bytes."""
    def run(rows: pa.Table) -> pa.Table:
        done = rows.filter(pa.compute.equal(pa.compute.binary_length(rows["h"]), 0))
        live = rows.filter(pa.compute.greater(pa.compute.binary_length(rows["h"]), 0))
        dk, dcopy, dstart, dsize = (_numbers(done[c].to_pylist(), t) for c, t in (("k", "<i8"), ("copy", "<i4"), ("start", "<i8"), ("size", "<i8")))
        x = {c: np.frombuffer(b"".join(live[c].to_pylist()), t) for c, t in (("h", "<u8"), ("c", "<u8"), ("sides", "<u8"), ("size", "u1"))}
        x |= {c: _numbers(live[c].to_pylist(), t) for c, t in (("k", "<i8"), ("copy", "<i4"), ("start", "<i8"))}
        order = np.argsort(x["h"], kind="stable")
        h = x["h"][order]
        edge = np.flatnonzero(np.diff(h, prepend=~h[:1], append=~h[-1:]))
        count = np.diff(edge)
        order = order[np.repeat(count, count) > 1]
        x = {c: v[order] for c, v in x.items()}
        order = np.lexsort((x["start"], x["copy"], x["k"], x["c"], x["h"]))
        x = {c: v[order] for c, v in x.items()}
        x["stop"] = x["start"] + x["size"]
        other = np.ones(len(order), bool)
        other[1:] = (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1])
        first = {c: v[other] for c, v in x.items()}
        ask = _shared(first["h"], first["sides"] >> np.uint64(32)) | _shared(first["h"], first["sides"] & np.uint64(0xFFFFFFFF))
        first = {c: v[ask] for c, v in first.items()}
        asked = np.unique(first["h"], return_inverse=True, return_counts=True)
        groups = (-(-asked[2] // PIECES))[asked[1]].astype("<i4")
        covered = (np.concatenate(v) for v in ((dk, x["k"][~other]), (dcopy, x["copy"][~other]), (dstart, x["start"][~other]), (dstart + dsize, x["stop"][~other])))
        return pa.concat_tables([_dealt(parts, *covered), _dealt(parts, *(first[c] for c in ("k", "copy", "start", "stop", "h")), groups)])
    return run


def _smaller_before(x: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element that is smaller, -1 if none: pointers jump until all are settled."""
    at = np.arange(-1, len(x) - 1)
    todo = np.flatnonzero((at >= 0) & (x[np.maximum(at, 0)] > x))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (x[np.maximum(at[todo], 0)] > x[todo])]
    return at


def later_copies(text: np.ndarray, starts: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which of the strings text[s : s + LENGTH] occur at a smaller position: longest previous factor of LENGTH or more."""
    b = np.concatenate([text, np.zeros(LENGTH, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(text) + LENGTH - 7, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | b[i:len(word) + i]
    rank, reach = np.unique(word[:len(text)], return_inverse=True)[1].astype(np.int64), 8
    while reach < LENGTH:
        step = min(reach, LENGTH - reach)
        ahead = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        rank, reach = np.unique(rank * (len(text) + 1) + ahead, return_inverse=True)[1].astype(np.int64), reach + step
    own = rank[starts]
    suffixes = np.lexsort((position, own))                     # suffix order, cut at LENGTH bytes
    value, level = position[suffixes], own[suffixes]
    before = _smaller_before(value)
    after = len(value) - 1 - _smaller_before(value[::-1])[::-1]
    ok = (before >= 0) & (level[np.maximum(before, 0)] == level)
    ok |= (after < len(value)) & (level[np.minimum(after, len(value) - 1)] == level)
    out = np.zeros(len(starts), bool)
    out[suffixes] = ok
    return out


def _equal(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Step 3 for single strings known by their digests: all but the earliest of equal ones."""
    h, k, copy, start = (rows[c].to_numpy() for c in ("h", "k", "copy", "start"))
    digest = np.frombuffer(b"".join(rows["content"].to_pylist()), "<u8").reshape(-1, DIGEST // 8).T
    order = np.lexsort((start, copy, k, *digest, h))
    later = order[1:][np.all([x[order[1:]] == x[order[:-1]] for x in (h, *digest)], axis=0)]
    later = later[np.lexsort((start[later], copy[later], k[later]))]
    return _ranges(k[later], copy[later], start[later], start[later] + LENGTH)


def _copies(parts: int):
    """Step 3 for one group: covered ranges among pieces whose bytes are known."""
    def run(rows: pa.Table) -> pa.Table:
        rows = _fetched(rows)
        single = pa.compute.equal(pa.compute.binary_length(rows["content"]), DIGEST)
        out = [_equal(rows.filter(single))]
        rows = rows.filter(pa.compute.invert(single))
        order = np.argsort(rows["h"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        h, k, copy, start = (rows[c].to_numpy() for c in ("h", "k", "copy", "start"))
        content = rows["content"].to_pylist()
        size = np.fromiter(map(len, content), np.int64, len(content))
        new = np.flatnonzero(h[1:] != h[:-1]) + 1
        lo = 0
        for hi in [*new, len(h)]:                              # whole minimizers, until there is enough to sort
            if hi == lo or hi < len(h) and size[lo:hi].sum() < SORTED_BYTES:
                continue
            text = np.frombuffer(b"".join(content[lo:hi]), np.uint8)
            begin = np.cumsum(size[lo:hi]) - size[lo:hi]
            n = size[lo:hi] - LENGTH + 1
            piece = np.repeat(np.arange(lo, hi), n)
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.empty(len(piece), np.int64)
            place[np.lexsort((start[piece] + shift, copy[piece], k[piece]))] = np.arange(len(piece))
            hit = np.flatnonzero(later_copies(text, np.repeat(begin, n) + shift, place))
            piece, at = piece[hit], start[piece[hit]] + shift[hit]
            order = np.lexsort((at, copy[piece], k[piece]))
            out.append(_ranges(k[piece][order], copy[piece][order], at[order], at[order] + LENGTH))
            lo = hi
        return _dealt(parts, *(np.concatenate(x) for x in zip(*out))).select(["part", "ranges"])
    return run


def _fetch(spread: int):
    """The bytes of requested pieces; a crowded minimizer's strings go one by one, as digests, to the group of their hash."""
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        texts = dict(zip(rows["copy"].to_pylist(), zip(rows["k"].to_pylist(), rows["raw"].to_pylist()))) if len(asked) else {}
        h, groups = _numbers(asked["h"].to_pylist(), "<i8"), _numbers(asked["groups"].to_pylist(), "<i4")
        for copy, start, size, a, n in zip(*(x.tolist() for x in (*_undealt(asked), h, groups))):
            k, raw = texts[copy]
            if n == 1:
                out.append((a % spread, a, k, copy, start, raw[start:start + size]))
                continue
            for i in range(start, start + size - LENGTH + 1):
                one = hashlib.blake2b(raw[i:i + LENGTH], digest_size=DIGEST).digest()
                part = int.from_bytes(one[:8], "little") % n
                group = int(mixed(np.array([(a + part) & (1 << 64) - 1], np.uint64))[0]) % spread
                out.append((group, a, k, copy, i, one))
        packed = []
        for group, some in groupby(sorted(out, key=itemgetter(0)), key=itemgetter(0)):
            *numbers, content = [*zip(*some)][1:]
            numbers = (np.array(x, t) for x, t in zip((*numbers, [*map(len, content)]), _BYTES.values()))
            packed.append((group, *map(_planes, numbers), pa.compress(b"".join(content), "zstd", asbytes=True)))
        kinds = (pa.int64(), *[pa.binary()] * 6)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*packed) if packed else ((),) * 7, kinds)], names=["grp", *_BYTES, "content"])
    return run


def _fetched(rows: pa.Table) -> pa.Table:
    """One row for each piece of what _fetch has packed."""
    columns = {c: _numbers(rows[c].to_pylist(), t) for c, t in _BYTES.items()}
    sizes = [_numbers([x], _BYTES["size"]) for x in rows["size"].to_pylist()]
    content = []
    for raw, size in zip(rows["content"].to_pylist(), sizes):
        raw = pa.decompress(raw, int(size.sum()), "zstd", asbytes=True)
        stop = np.cumsum(size)
        content += [raw[lo:hi] for lo, hi in zip((stop - size).tolist(), stop.tolist())]
    return pa.table({c: columns[c] for c in ("h", "k", "copy", "start")} | {"content": pa.array(content, pa.binary())})


def _kept(rows: pa.Table, covered: pa.Table) -> pa.Table:
    """Step 4: what remains of each document of a part."""
    copy, start, size = _undealt(covered)
    lo = copy << 32 | start
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], (lo + size)[order]
    new = np.flatnonzero(np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1])[:len(lo)])
    lo, hi = lo[new], np.maximum.reduceat(hi, new) if len(new) else hi
    copy, start, stop = lo >> 32, lo & 0xFFFFFFFF, hi & 0xFFFFFFFF
    out = []
    number = rows["copy"].to_numpy()
    for raw, a, b in zip(rows["raw"], np.searchsorted(copy, number), np.searchsorted(copy, number, "right")):
        raw, left, at = raw.as_buffer(), hashlib.sha256(), 0
        for begin, end in zip(start[a:b].tolist(), stop[a:b].tolist()):
            left.update(raw[at:begin])
            at = end
        left.update(raw[at:])
        out.append((len(raw), int((stop[a:b] - start[a:b]).sum()), int(b - a), left.hexdigest()))
    n, gone, spans, sha = zip(*out) if out else ((),) * 4
    return pa.table([rows["doc_id"].cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha, pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long").alias("k"), raw.alias("raw"))
    # numbered within a part, which is what all joins go by: the texts are shuffled once
    copy = F.row_number().over(Window.partitionBy("part").orderBy("k", F.col("doc_id").asc_nulls_last(), "raw"))
    rows = keyed.withColumn("part", F.pmod(F.hash("k"), F.lit(parts))).withColumn("copy", copy)

    packed = rows.select("k", "copy", "raw").sortWithinPartitions("k", "copy").mapInArrow(_pack(buckets), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(_settle(parts), _FOUND)
    asked = found.where("octet_length(h) > 0")
    bytes_ = rows.select("part", "k", "copy", "raw").groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(
        _fetch(2 * buckets), "grp bigint, h binary, k binary, copy binary, start binary, size binary, content binary")
    copies = bytes_.groupBy("grp").applyInArrow(_copies(parts), "part int, ranges binary")
    covered = found.where("octet_length(h) = 0").select("part", "ranges").union(copies)
    return rows.select("part", "doc_id", "copy", "raw").groupBy("part").cogroup(covered.groupBy("part")).applyInArrow(
        _kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op2_substring_dedup(spark, sf_dir):
    """What remains of every document without bytes of 100-byte strings seen earlier."""
    return deduplicated(table(spark, sf_dir, "documents"))
