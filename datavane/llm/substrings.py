"""Removal of repeated 50-word passages: a count-min prefilter over all windows, then exact grouping of what it passes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_BLOCK = 18  # a block of the sketch has 2**18 cells
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values, by doubling."""
    have, low = 1, x
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(x) - width + 1], low[width - have :])
    return low


def _windows(raw, offs, size):
    """(row, start word in it, start word, word spans, minimiser) of every window of `size` words that lies in one row.

    The minimiser is the least hash among the window's runs of size // 2 + 1 words. Equal windows have equal minimisers, so a
    window can only be repeated where its minimiser is, and neighbours mostly share theirs."""
    starts, ends, row = common.word_spans(raw, offs)
    if len(starts) < size:
        return None
    k = size // 2 + 1
    low = _least(common.grams(common.rolling_sums(common.word_hashes(raw, starts, ends)), k), size - k + 1)
    at = np.flatnonzero(row[: len(low)] == row[size - 1 : size - 1 + len(low)])
    first = np.searchsorted(row, row[at], "left")
    return row[at], at - first, at, (starts, ends), low[at]


def _minimisers(batches, size):
    """(batch, row of the batch, minimiser) of every run of windows of one row that share theirs; in parts."""
    for b in batches:
        for lo, _, raw, offs in common.text_slices(b):
            if (w := _windows(raw, offs, size)) is None or not len(w[4]):
                continue
            row, low = w[0], w[4]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
            yield b, lo + row[new], low[new]


def _plain(raw, starts, ends):
    """The words with one space between them, and where each begins and ends there."""
    n = ends - starts
    at = np.cumsum(n + 1) - n - 1
    out = np.full(int(n.sum() + len(n)), 0x20, dtype=np.uint8)
    out[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())] = raw[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())]
    return out.tobytes(), at, at + n


def _cells(low: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(low * m) >> np.uint64(64 - bits) for m in _ROWS]


def _bits(docs: DataFrame, size: int, cells_per_item: int) -> int:
    """The sketch has about cells_per_item cells for each minimiser that the bytes let expect, at every size of the corpus."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = total / 6 / (size // 4)
    return int(min(60, max(_BLOCK, np.ceil(np.log2(max(1.0, items * cells_per_item))))))


def sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """For each of two count-min rows, one bit a cell: is the merged count 2 or more?

    Each partition counts the minimisers of its windows (once for each run of windows that share one) into sparse blocks of
    cells; the blocks are merged by adding, cell by cell. A cell counts all runs of each of its minimisers, and a window that two rows
    hold has its minimiser in both, so a cell is at least the number of rows that hold any window it stands for."""

    def count(batches):
        kept, n = [], 0

        def flush():
            low = np.concatenate(kept)
            for r, cell in enumerate(_cells(low, bits)):
                cell, times = np.unique(cell, return_counts=True)
                block = (cell >> np.uint64(_BLOCK)).astype(np.int64)
                cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
                inside = (cell & np.uint64((1 << _BLOCK) - 1)).astype("<u4") | (times > 1).astype("<u4") << 31
                parts = np.split(inside, cuts)
                yield pa.RecordBatch.from_arrays([pa.array((r << 40) + block[np.concatenate([[0], cuts])]), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "cells"])

        for _, _, low in _minimisers(batches, size):
            kept.append(low)
            n += len(low)
            if n > 500_000:
                yield from flush()
                kept, n = [], 0
        if kept:
            yield from flush()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        cells = np.frombuffer(b"".join(f["cells"]), dtype="<u4")
        low = np.uint32((1 << _BLOCK) - 1)
        total = np.bincount(cells & low, minlength=1 << _BLOCK) + np.bincount(cells[cells >> 31 == 1] & low, minlength=1 << _BLOCK)
        return pd.DataFrame({"block": f["block"].iloc[:1], "bits": [np.packbits(total > 1, bitorder="little").tobytes()]})

    merged = docs.select("text").mapInArrow(count, "block long, cells binary").groupBy("block").applyInPandas(merge, "block long, bits binary")
    out = np.zeros((len(_ROWS), max(1 << (bits - 3), 1)), dtype=np.uint8)
    for r in merged.toLocalIterator():
        at = (r.block & ((1 << 40) - 1)) << (_BLOCK - 3)
        part = np.frombuffer(r.bits, dtype=np.uint8)
        out[r.block >> 40, at : at + len(part)] = part[: out.shape[1] - at]
    return out


def sketched_rows(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """doc_id, lows: the minimisers of each row that both count-min rows estimate at 2 or more. The same sketch as a table
    spread over the executors: Spark adds up the cells of each partition, then of all; nothing is broadcast or collected."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches):
        for b, row, low in _minimisers(batches, size):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(low.view(np.int64)), *[pa.array(c.astype(np.int64)) for c in _cells(low, bits)]], ["doc_id", "low", "c0", "c1"])

    left = common.saved(docs.select("doc_id", "text").mapInArrow(emit, f"doc_id {kind}, low long, c0 long, c1 long"), "minimisers")
    for c in ("c0", "c1"):
        twice = left.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c)
        left = left.join(common.saved(twice, "cells"), c, "left_semi")
    return common.saved(left.groupBy("doc_id").agg(F.collect_set("low").alias("lows")), "minimisers")


def repeated_windows(docs: DataFrame, size: int = 50, cells_per_item: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, starts: the first words of all windows of docs (doc_id, text) whose word sequence also starts in a row with a
    smaller doc_id.

    First pass: the merged sketch, about cells_per_item cells a minimiser whatever the corpus, so about one in thirty never-repeated
    windows passes at any size. Up to broadcast_bytes (about 2 GB of text by default) its bits are broadcast; beyond
    that the same sketch is a table, joined with the rows' minimisers. A smaller sketch passes more windows, never fewer.
    Second pass: only windows whose minimiser is estimated at 2 or more go on, as a 128-bit BLAKE2b digest of all their words; these
    are grouped exactly for their smallest doc_id (combined before the shuffle), and joined with the windows again (open to
    skew splitting). Null ids are never smaller than others and never removed from."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    bits = _bits(docs, size, cells_per_item)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if len(_ROWS) << (bits - 3) <= broadcast_bytes:
        twice = spark.sparkContext.broadcast(sketch(docs, size, bits))
        rows = docs.select("doc_id", "text")
    else:
        twice = None
        some = sketched_rows(docs, size, bits)
        rows = common.left_by_id(docs.select("doc_id", "text"), some).where("lows is not null")

    def passed(b, lo, row, low):
        ok = np.ones(len(low), dtype=bool)
        if twice is not None:
            for bitmap, cell in zip(twice.value, _cells(low, bits), strict=True):
                ok &= (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return ok
        lists = b.column("lows")
        for r in np.unique(row).tolist():
            a, z = np.searchsorted(row, [r, r + 1])
            ok[a:z] = np.isin(low[a:z], np.array(lists[lo + r].as_py(), dtype=np.int64).view(np.uint64))
        return ok

    def emit(batches):
        for b in batches:
            ids = b.column("doc_id")
            for lo, _, raw, offs in common.text_slices(b):
                if (w := _windows(raw, offs, size)) is None:
                    continue
                row, start, at, spans, low = w
                ok = passed(b, lo, row, low)
                if not ok.any():
                    continue
                row, start, at = row[ok], start[ok], at[ok]
                words, begin, end = _plain(raw, *spans)
                keys = b"".join([hashlib.blake2b(words[x:y], digest_size=16).digest() for x, y in zip(begin[at].tolist(), end[at + size - 1].tolist(), strict=True)])
                key = np.frombuffer(keys, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + row)), pa.array(start.astype(np.int32)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())], ["doc_id", "start", "h1", "h2"])

    windows = rows.mapInArrow(emit, f"doc_id {kind}, start int, h1 long, h2 long")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("hi > lo").select("h1", "h2", "lo")
    first = common.saved(first, "repeated")  # so that both sides of the join are shuffled for it, which lets a hot window be split
    return windows.join(first, ["h1", "h2"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))


def _covered(n_words: int, starts, size: int) -> np.ndarray:
    """Which words a window with one of these first words covers."""
    at = np.array(starts, dtype=np.int64)
    at = at[at + size <= n_words]
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_starts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs and the starts of their repeated windows, null for none."""
    return common.left_by_id(docs, gone.withColumnRenamed("starts", "__starts"))


def removed_words(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the remaining words joined by one space) of every row of docs.

    A word is removed when a window that covers it also starts in a row with a smaller doc_id; windows are judged on the
    input. Null texts have no words; rows with fewer words than a window lose nothing; nor do rows with a null id. Rows
    that share a doc_id are one document: a window in any of them is removed from all, at its own place.
    An empty table gives an empty result; other columns are not read."""
    base = docs.select("doc_id", "text")
    gone = common.saved(repeated_windows(base, size), "repeats")

    def cut(batches):
        for b in batches:
            n, m, sha = [], [], []
            for text, starts in zip(b.column("text"), b.column("__starts"), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                left = words
                if starts.is_valid and len(starts.values):
                    gone_words = _covered(len(words), starts.values, size)
                    left = [words[i] for i in np.flatnonzero(~gone_words).tolist()]
                n.append(len(words))
                m.append(len(words) - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_starts(base, gone).mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs with the words that removed_words() counts taken out of text: a row that loses words has the others joined by one
    space, any other row keeps its text as it is. All columns and rows stay, rows that lose every word with an empty text."""
    gone = common.saved(repeated_windows(docs.select("doc_id", "text"), size), "repeats")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, at in zip(text, starts, strict=True):
            if t is not None and at is not None and len(at):
                words = t.encode().split()
                t = b" ".join([words[i] for i in np.flatnonzero(~_covered(len(words), at, size)).tolist()]).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = _with_starts(docs, gone)
    lost = rows.where("__starts is not null").withColumn("text", cut("text", "__starts"))
    return rows.where("__starts is null").unionByName(lost).select(docs.columns)
