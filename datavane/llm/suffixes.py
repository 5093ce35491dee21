"""Removal of repeated byte strings: suffix arrays of shards that hold the only places where a string can be repeated."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .substrings import _least

GRAM = 32  # bytes of an anchor
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_PLACE = np.uint64((1 << 21) - 1)
_BLOCK = 1 << 20  # window starts of a block, so that a place in a block fits 21 bits
_PIECE = 1 << 10  # window starts of a piece at most
_SEPARATOR = b"\xff"  # in no UTF-8 text


def _pieces(raw: np.ndarray, offs: np.ndarray, size: int):
    """(row, first window start in the row's bytes, window starts, anchor, does the anchor occur again in the piece?) of the pieces of
    a block of rows.

    A window's anchor is its gram of the least hash, the leftmost of equal ones, so equal windows have equal anchors at equal places. A
    piece is a run of windows with one anchor hash. Where all have the same place of it, no two windows of the piece are equal."""
    rows = np.flatnonzero(np.diff(offs) >= size)
    if not len(rows):
        return None
    eights, m = common._eights(raw), len(raw) - GRAM + 1
    grams = eights[:m] * _STEPS[0]
    for i in range(1, GRAM // 8):
        grams += eights[8 * i : 8 * i + m] * _STEPS[i]
    grams = common.mixed(grams)
    place = _least((grams & ~_PLACE) | np.arange(m, dtype=np.uint64), size - GRAM + 1) & _PLACE
    n = offs[rows + 1] - offs[rows] - size + 1
    at = np.repeat(offs[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
    place = place[at]
    anchor, row = grams[place], np.repeat(rows, n)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    again = np.concatenate([[False], place[1:] != place[:-1]]) & ~new
    new |= (np.arange(len(at)) - first) % _PIECE == 0
    cut = np.flatnonzero(new)
    return row[cut], at[cut] - offs[row[cut]], np.diff(np.append(cut, len(at))), anchor[cut], np.logical_or.reduceat(again, cut)


def _blocks(batch, size):
    """(first row, bytes, offsets, place of the first byte in its row) of runs of rows, long texts in blocks that overlap by a window."""
    for lo, _, raw, offs in common.text_slices(batch):
        if len(raw) <= 2 * _BLOCK - size:
            yield lo, raw, offs, 0
            continue
        for r in range(len(offs) - 1):
            for at in range(int(offs[r]), max(int(offs[r]) + 1, int(offs[r + 1]) - size + 1), _BLOCK):
                part = raw[at : min(int(offs[r + 1]), at + _BLOCK + size - 1)]
                yield lo + r, part, np.array([0, len(part)]), at - int(offs[r])


def anchored(docs: DataFrame, size: int) -> DataFrame:
    """uid, key, d1, d2, start, n, again of every piece of docs (uid, text): the anchor's hash, BLAKE2b of the piece's bytes, its first
    byte and how many windows start in it."""

    def emit(batches):
        for b in batches:
            uid = b.column("uid")
            for lo, raw, offs, shift in _blocks(b, size):
                if (found := _pieces(raw, offs, size)) is None:
                    continue
                row, start, n, key, again = found
                began = (offs[row] + start).tolist()
                view = memoryview(np.ascontiguousarray(raw))
                made = b"".join([hashlib.blake2b(view[x : x + k + size - 1], digest_size=16).digest() for x, k in zip(began, n.tolist(), strict=True)])
                d = np.frombuffer(made, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(lo + row)), pa.array(key.view(np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array((start + shift).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], ["uid", "key", "d1", "d2", "start", "n", "again"])

    return docs.select("uid", "text").mapInArrow(emit, "uid binary, key long, d1 long, d2 long, start int, n int, again boolean")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order, by Larsson-Sadakane refinement: sorted by eight bytes first, then only groups that are
    still equal are sorted by the rank of what follows at twice the depth."""
    n = len(text)
    key = common._eights(text)[:n].byteswap()
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    last = np.append(new[1:], True)
    left = np.flatnonzero(~(new & last))
    depth = 8
    while len(left):
        at = order[left]
        behind = at + depth
        both = (rank[at] << 32) | np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(both)
        order[left], both = at[by], both[by]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[order[left]] = np.maximum.accumulate(np.where(new, left, 0))
        left = left[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix before it in order or -1, length of the prefix that they share) of every place, after Kasai: where the bytes before both
    are equal, the shared prefix is one shorter than that of the place before; only the other places are compared."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.ones(n, bool)
    own[1:] = (before[1:] <= 0) | (text[:-1] != text[before[1:] - 1])
    eights = common._eights(text)
    shared = np.zeros(n, np.int64)
    a = np.flatnonzero(own & (before >= 0))
    b = before[a]
    size, some = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(some):
        x, y = a[some] + size[some], b[some] + size[some]
        inside = np.maximum(x, y) < n
        some, x, y = some[inside], x[inside], y[inside]
        off = eights[x] ^ eights[y]
        same = off == 0
        size[some[same]] += 8
        off, ends = off[~same], some[~same]
        for bits in (32, 16, 8):
            low = (off & np.uint64((1 << bits) - 1)) == 0
            size[ends[low]] += bits // 8
            off[low] >>= np.uint64(bits)
        some = some[same]
    shared[a] = np.minimum(size, n - np.maximum(a, b))
    place = np.arange(n)
    since = np.maximum.accumulate(np.where(own, place, 0))
    return before, np.maximum(shared[since] - (place - since), 0)


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _shard(size: int, buckets: int):
    """Of one shard's pieces: spans (uid, lo, hi) of single pieces that repeated windows cover, and for anchors that are split over
    shards sorted digests of the shard's distinct windows, by bucket."""

    def find(f: pd.DataFrame) -> pd.DataFrame:
        parts = f["bytes"].tolist()
        text = np.frombuffer(_SEPARATOR.join(parts) + _SEPARATOR, dtype=np.uint8)
        length = np.array([len(p) for p in parts])
        begin = np.cumsum(length + 1) - length - 1
        order = suffix_array(text)
        before, shared = common_prefixes(text, order)
        many = np.zeros(len(text), bool)
        many[shared >= size] = True
        many[before[shared >= size]] = True
        out = []
        for i in np.flatnonzero(f["copies"].to_numpy() == 1).tolist():
            at = int(f["start"].iat[i])
            for lo, hi in _stretches(many[begin[i] : begin[i] + length[i] - size + 1]):
                out.append((f["uid"].iat[i], at + lo, at + hi - 1 + size, None, None, None, None, None))
        split = np.flatnonzero(f["split"].to_numpy())
        if len(split):
            n = length[split] - size + 1
            at = np.repeat(begin[split] - np.cumsum(n) + n, n) + np.arange(n.sum())
            piece = np.repeat(split, n)
            head = shared[at] < size  # the first of equal windows in order
            at, piece = at[head], piece[head]
            raw = text.tobytes()
            made = b"".join([hashlib.blake2b(raw[x : x + size], digest_size=16).digest() for x in at.tolist()])
            keys = np.frombuffer(made, dtype="S16") if made else np.zeros(0, "S16")
            order = np.argsort(keys, kind="stable")
            bucket = (np.frombuffer(made, dtype=">u4").reshape(-1, 4)[:, 0].astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)[order]
            single = ~many[at] & (f["copies"].to_numpy()[piece] == 1)
            uids = np.array([bytes(u) for u in f["uid"]], dtype="S16")
            where = f["start"].to_numpy()[piece] + at - begin[piece]
            for c in np.unique(bucket).tolist():
                o = order[bucket == c]
                out.append((None, None, None, c, _raw(keys[o], 16), _raw(uids[piece[o]], 16), where[o].astype("<i4").tobytes(), single[o].tobytes()))
        return pd.DataFrame(out, columns=["uid", "lo", "hi", "bucket", "keys", "uids", "starts", "single"])

    return find


def _raw(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype(f"S{width}")).view(np.uint8).tobytes()


def _merged(size: int):
    """Of one bucket: the sorted digests of all shards, merged two by two by binary search; a digest that is found is repeated."""

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint8).reshape(-1, 16) for k in f["keys"]]
        flat = np.concatenate(keys)
        ends = np.ones((len(flat), 17), np.uint8)  # a last byte, since trailing zeros do not count in comparisons
        ends[:, :16] = flat
        flat = ends.reshape(-1).view("S17")
        seen = np.zeros(len(flat), bool)
        cut = np.cumsum([0] + [len(k) for k in keys])
        runs = [np.arange(x, y) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        while len(runs) > 1:
            paired = []
            for x, y in zip(runs[::2], runs[1::2], strict=False):
                at = np.searchsorted(flat[y], flat[x])
                found = flat[y][np.minimum(at, len(y) - 1)] == flat[x]
                seen[x[found]] = seen[y[at[found]]] = True
                paired.append(np.insert(y, at[~found], x[~found]))
            runs = paired + ([runs[-1]] if len(runs) % 2 else [])
        single = np.frombuffer(b"".join(f["single"]), dtype=bool)
        uids = np.frombuffer(b"".join(f["uids"]), np.uint8).reshape(-1, 16)
        starts = np.frombuffer(b"".join(f["starts"]), "<i4")
        hit = np.flatnonzero(seen & single)
        return pd.DataFrame({"uid": [uids[i].tobytes() for i in hit.tolist()], "lo": starts[hit], "hi": starts[hit] + size})

    return merge


def _with_uid(docs: DataFrame) -> DataFrame:
    """docs and uid: 16 bytes that stand for a row's doc_id and whole text."""
    named = F.when(F.col("doc_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string")))
    uid = F.unhex(F.substring(F.sha2(F.concat(named, F.lit("|"), F.coalesce("text", F.lit(""))), 256), 1, 32))
    return docs.select(uid.alias("uid"), "doc_id", "text")


def _joined(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs (uid, doc_id, text), left-joined with a written table (uid, ...)."""
    rows = docs.select(F.col("uid").alias("doc_id"), F.col("doc_id").alias("id"), "text")
    return common.left_by_id(rows, table.withColumnRenamed("uid", "doc_id")).withColumnRenamed("doc_id", "uid").withColumnRenamed("id", "doc_id")


def repeated_spans(docs: DataFrame, size: int = 400, shard_bytes: int = 1 << 21) -> DataFrame:
    """uid, spans: for docs (uid, doc_id, text) the byte spans (lo, hi) covered by strings of `size` bytes that start elsewhere too.

    1. Every window of `size` bytes has an anchor, its 32-byte gram of the least hash, and a piece is a run of windows with one
       anchor. Equal windows have equal anchors, so an anchor that occurs once (and not twice in its piece) repeats nothing. Anchors are
       counted with partial sums; a hot one costs a row a task.
    2. An anchor whose pieces all have the same bytes (128-bit BLAKE2b) is repeated whole; so is any piece that has a copy. Copies need no
       more work, whatever their number.
    3. The other pieces of repeated anchors, and one of each group of copies, go with their bytes to shards of about shard_bytes by
       their anchor. Each shard's suffix array and common prefixes tell which windows are repeated in it. All places of an
       anchor are in one shard, so that is all, except
    4. for anchors with more bytes than half a shard: their pieces are dealt over several shards, and these shards' sorted
       distinct windows (128-bit digests) are merged by binary search, in buckets whose number follows their windows."""
    runs = common.saved(anchored(docs, size), "anchors")
    same = F.min(F.struct("d1", "d2")) == F.max(F.struct("d1", "d2"))
    anchors = runs.groupBy("key").agg(F.count("*").alias("n_places"), same.alias("same"), F.max("again").alias("twice")).where("n_places > 1 or twice")
    anchors = anchors.select("key", (F.col("same") & (F.col("n_places") > 1)).alias("whole"))
    found = common.saved(runs.join(anchors, "key").drop("again"), "repeated")
    span = [F.col("start").alias("lo"), (F.col("start") + F.col("n") + (size - 1)).alias("hi")]
    whole = found.where("whole").select("uid", *span)
    mixed = found.where("not whole")
    rep = F.min(F.struct("uid", "start", "n")).alias("rep")
    groups = common.saved(mixed.groupBy("key", "d1", "d2").agg(F.count("*").alias("copies"), rep).select("key", "d1", "d2", "copies", "rep.*"), "pieces")
    copied = mixed.join(groups.where("copies > 1").select("key", "d1", "d2"), ["key", "d1", "d2"], "left_semi").select("uid", *span)
    heat = common.saved(groups.groupBy("key").agg(F.sum(F.col("n") + size).alias("bytes"), F.sum("n").alias("windows")), "heat")
    hot = heat.where(F.col("bytes") > shard_bytes // 2)
    total, windows = heat.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("bytes") > shard_bytes // 2, F.col("windows"))), F.lit(0))).first()
    parts = hot.select("key", F.ceil(F.col("bytes") * 2 / shard_bytes).alias("parts"))
    shards, buckets = max(1, -(-total // shard_bytes)), max(1, -(-windows // (1 << 19)))
    dealt = groups.join(parts, "key", "left")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(-1 - F.pmod(F.xxhash64("key", F.pmod("d1", "parts")), F.lit(shards)))
    wanted = dealt.groupBy("uid").agg(F.collect_list(F.struct(shard.alias("shard"), "copies", "start", "n", F.col("parts").isNotNull().alias("split"))).alias("wanted"))
    held = _joined(docs, common.saved(wanted, "wanted")).where("wanted is not null").select("uid", "text", "wanted")

    names = ["uid", "shard", "copies", "start", "split", "bytes"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def cut(batches):
        out, held_bytes = [], 0
        for b in batches:
            for uid, text, many in zip(b.column("uid"), b.column("text"), b.column("wanted"), strict=True):
                view = memoryview(text.as_buffer())
                for w in many.as_py():
                    piece = bytes(view[w["start"] : w["start"] + w["n"] + size - 1])
                    out.append((uid.as_py(), w["shard"], w["copies"], w["start"], w["split"], piece))
                    held_bytes += len(piece)
                    if held_bytes > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held_bytes = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    contents = held.mapInArrow(cut, "uid binary, shard long, copies long, start int, split boolean, bytes binary")
    sorted_ = contents.groupBy("shard").applyInPandas(_shard(size, buckets), "uid binary, lo int, hi int, bucket long, keys binary, uids binary, starts binary, single binary")
    sorted_ = common.saved(sorted_, "shards")
    across = sorted_.where("bucket is not null").groupBy("bucket").applyInPandas(_merged(size), "uid binary, lo int, hi int")
    spans = whole.unionByName(copied).unionByName(sorted_.where("bucket is null").select("uid", "lo", "hi")).unionByName(across)
    return spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def removed_bytes(docs: DataFrame, size: int = 400, shard_bytes: int = 1 << 21) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) of every row of docs.

    A byte is removed when a string of `size` bytes that covers it also starts anywhere else, in the same row too; strings are judged
    on the input. Null texts are empty; texts shorter than `size` lose nothing. Each row is a document of its own, whatever its
    doc_id, so repeated rows of `size` bytes lose everything. Very long texts are read in blocks that overlap by a window. An empty table
    gives an empty result; other columns are not read."""
    base = _with_uid(docs)
    gone = common.saved(repeated_spans(base, size, shard_bytes), "spans")

    def cut(batches):
        for b in batches:
            n, m, k, sha = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                done, lost, count, left = 0, 0, 0, hashlib.sha256()
                if spans.is_valid:
                    both = spans.values.flatten()
                    lo, hi = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in both)
                    by = np.argsort(lo)
                    lo, hi = lo[by], np.maximum.accumulate(hi[by])
                    new = np.concatenate([[True], lo[1:] > hi[:-1]])
                    for x, y in zip(lo[new].tolist(), hi[np.append(new[1:], True)].tolist(), strict=True):
                        left.update(data[done:x])
                        done, lost, count = y, lost + y - x, count + 1
                left.update(data[done:])
                n.append(len(data))
                m.append(lost)
                k.append(count)
                sha.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _joined(base, gone).select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
