"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common


#: Texts are encoded in groups of so many bytes: a group's arrays are many times as large, and a pipeline's executor is nearly full by then.
SLICE_BYTES = 1 << 20


def token_pieces(docs: DataFrame, ranks_file: str, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every whole text of docs (doc_id, text).

    A document is its ids and then end_id. Longer ones are cut into pieces of `capacity` ids, of which the first may be
    shorter. ranks_file: the vocabulary as base64 bytes and rank a line; its ids are those of the tokenizers file
    `vocabulary`, which tells the special tokens that keep their own id in a text. A null text is empty and gives one piece;
    repeated rows and null ids are documents like any other."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("ranks", pat_str=bpe._SPLIT.pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            size[i] = len(token)

        def many(joined, sizes, others):
            ids = np.array(core.encode_ordinary(joined.decode()), dtype=np.uint32)
            upto = np.concatenate([[0], np.searchsorted(np.cumsum(size[ids]), np.cumsum(sizes), "left") + 1])
            rest = [np.array(core.encode_ordinary(t), dtype=np.uint32) for t in others]
            return np.concatenate([ids, *rest]), np.concatenate([np.diff(upto), np.array([len(r) for r in rest], dtype=np.int64)])

        coder = bpe.ChunkEncoder(many, bpe.special_tokens(vocabulary), limit=100_000)
        del ranks
        tail = end_id.to_bytes(4, "little")
        for batch in batches:
            for first, n_docs, raw, offs in common.text_slices(batch, limit=SLICE_BYTES):
                flat, at = coder.encode(raw, offs)
                doc, rows = [], []
                for i in range(n_docs):
                    own = flat[at[i] : at[i + 1]].tobytes() + tail
                    n = len(own) // 4
                    lo, piece = 0, 0
                    hi = (n - 1) % capacity + 1
                    while lo < n:
                        doc.append(first + i)
                        rows.append((piece, lo, hi - lo, zlib.crc32(memoryview(own)[4 * lo : 4 * hi])))
                        lo, hi, piece = hi, hi + capacity, piece + 1
                piece, start, length, crc = np.array(rows, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _priced(price: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, lengths): for each length that is left, one copy of it and the filling of largest price that fits beside it.

    One knapsack by dynamic programming, whose items are 1, 2, 4, ... copies of a length, as many as are left, gives the best
    filling of every capacity; all patterns are then read off it together."""
    lengths = np.flatnonzero(left)
    items = []
    for size in lengths[::-1].tolist():
        copies, many = min(int(left[size]), capacity // size), 1
        while copies:
            many = min(many, copies)
            items.append((size, many))
            copies, many = copies - many, many * 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), dtype=bool)
    for i, (size, many) in enumerate(items):
        w = size * many
        with_it = best[: capacity + 1 - w] + price[size] * many
        better = with_it > best[w:] + 1e-12
        took[i, w:] = better
        best[w:][better] = with_it[better]
    out = np.zeros((len(lengths), capacity + 1), dtype=np.int32)
    rows = np.arange(len(lengths))
    out[rows, lengths] = 1
    room = capacity - lengths
    for i in range(len(items) - 1, -1, -1):
        size, many = items[i]
        on = took[i, room]
        if on.any():
            out[on, size] += many
            room[on] -= size * many
    return np.minimum(out, left, out=out, casting="unsafe"), lengths


def patterns(demand: np.ndarray, capacity: int = 1024, **how) -> tuple[list[tuple[np.ndarray, int]], dict]:
    """[(pattern, times)] of short_patterns() with each pattern written out: copies of each length, index = length."""
    found, report = short_patterns(demand, capacity, **how)
    out = []
    for at, copies, k in found:
        p = np.zeros(capacity + 1, dtype=np.int64)
        p[at] = copies
        out.append((p, k))
    return out, report


def short_patterns(demand: np.ndarray, capacity: int = 1024, rounds: int = 3, step: float = 1.0, power: float = 1.1) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], dict]:
    """[(lengths, copies of each, times)] of patterns that hold the demand exactly, and a report. Only the lengths that a pattern has are kept.

    The linear program: fewest patterns that cover the demand. Multiplicative weights: a length starts at the price of its
    share of the capacity to `power`, a little over 1, as short pieces are easier to place; each round prices patterns by the
    knapsack, gives each length's uncovered share to its best pattern, and lowers the price of what is covered too far,
    exponentially in how far. The program's patterns are then rounded, those with the longest lengths first, each as often as
    the program uses it (once at least) where that is left; and it is solved again for what is left, until nothing is. So all sequences
    come from the program, at every size; work follows the number of lengths, not of documents.

    report: sequences, solutions, and bound: no packing has fewer sequences (whole sizes; lengths over half the capacity)."""
    left = demand.astype(np.int64).copy()
    sizes = np.arange(capacity + 1)
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    report = {"bound": int(max(-(-int((left * sizes).sum()) // capacity), int(left[capacity // 2 + 1 :].sum()))), "solutions": 0}
    while left.any():
        report["solutions"] += 1
        price = own = (sizes / capacity) ** power
        cover, used = np.zeros(capacity + 1), {}
        for r in range(rounds):
            found, seeds = _priced(price, left, capacity)
            share = np.maximum(left[seeds] - cover[seeds], 0.0) / (rounds - r)
            for p, t in zip(found, share, strict=True):
                if t > 0:
                    at = np.flatnonzero(p)  # only these few are kept, as a row of `found` would keep all of it
                    key = np.concatenate([at, p[at]]).astype(np.int32).tobytes()
                    used[key] = used.get(key, 0.0) + t
            cover += share @ found
            price = own * np.exp(-step * np.maximum(cover / np.maximum(left, 1) - (r + 1) / rounds, 0.0))
        held = [(*np.frombuffer(key, dtype=np.int32).reshape(2, -1), t) for key, t in used.items()]
        for at, copies, t in sorted(held, key=lambda x: (-int(x[0][-1]), -int((x[0] * x[1]).sum()), -x[2])):
            k = min(max(1, int(t)), int((left[at] // copies).min()))
            if k > 0:
                out.append((at, copies, k))
                left[at] -= k * copies.astype(np.int64)
    report["sequences"] = sum(k for *_, k in out)
    return out, report


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...), whose lengths are 1 to capacity.

    All sequences are patterns of the rounded configuration program. Only the histogram of lengths (capacity rows) reaches the driver, where patterns() solves it. Every piece then finds its
    place by its rank among the pieces of its length: ranks come from totals per partition and length, so a length with
    a third of all rows is never in one task. Offsets in a sequence go down the lengths, gapless from 0.
    Repeated rows and null ids are pieces like any other; an empty table gives an empty result."""
    kept = common.saved(pieces.withColumn("__p", F.spark_partition_id()), "pieces")
    counts = kept.groupBy("__p", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for r in histogram:
        demand[r.length] = r.n
    starts, rows, seq = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for at, copies, k in short_patterns(demand, capacity)[0]:
        offset = 0
        for size, c in zip(at[::-1].tolist(), copies[::-1].tolist(), strict=True):
            rows.append((size, int(starts[size]), c, seq, offset))
            starts[size] += k * c
            offset += size * c
        seq += k
    table: dict[int, list] = {}
    for size, first, c, s, offset in rows:
        table.setdefault(size, []).append((first, c, s, offset))
    arrays = {size: np.array(x, dtype=np.int64) for size, x in table.items()}
    places = kept.sparkSession.sparkContext.broadcast(arrays)  # entries follow the lengths (about 20,000 for 10**6 pieces), not the pieces
    own = Window.partitionBy("__p", "length").orderBy("doc_id", "piece", "start")
    ranked = kept.withColumn("__r", F.row_number().over(own) - 1).join(counts.select("__p", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__b")), ["__p", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for size in np.unique(n).tolist():
            at = np.flatnonzero(n == size)
            t = places.value[size]
            row = t[np.searchsorted(t[:, 0], r[at], "right") - 1]
            k = r[at] - row[:, 0]
            seq[at] = row[:, 2] + k // row[:, 1]
            off[at] = row[:, 3] + (k % row[:, 1]) * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked.withColumn("__x", place("length", (F.col("__r") + F.col("__b")).cast("long")))
    return out.select(*[c for c in pieces.columns], "__x.sequence_id", "__x.offset")
