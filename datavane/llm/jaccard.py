"""Similarity join on word shingles: size-banded tiles, bitmap signatures, exact intersection of sorted arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Cells of the frequency sketch that orders shingles: 2**21, 2 MB a task and 4 MB when merged, whatever the corpus.
BITS = 21
#: Two similar sets must share this part of the smaller one's size among their prefixes, which are longer by as much.
DEPTH = 20


def _row_shingles(raw, offs, k: int):
    """(hash, row) of every shingle: all runs of k words; the whole sequence where a row has fewer."""
    starts, ends, row = common.word_spans(raw, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = common.word_hashes(raw, starts, ends, fold=True)
    g = common.runs(h, k)
    ok = row[: len(g)] == row[k - 1 : k - 1 + len(g)]
    g, grow = g[ok], row[: len(ok)][ok]
    n = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(row, short, "left")
        whole = n[short].astype(np.uint64)  # starts from the number of words, as runs() does
        for i in range(k - 1):
            on = n[short] > i
            whole[on] = common.mixed(whole[on] + h[first[on] + i])
        g, grow = np.concatenate([g, whole]), np.concatenate([grow, short])
        o = np.argsort(grow, kind="stable")
        g, grow = g[o], grow[o]
    return g, grow


def _sets(batch: pa.RecordBatch, k: int):
    """(row of the batch, sorted distinct shingles) of every row."""
    for lo, n, raw, offs in common.text_slices(batch):
        g, row = _row_shingles(raw, offs, k)
        at = np.searchsorted(row, np.arange(n + 1))
        for i in range(n):
            yield lo + i, np.unique(g[at[i] : at[i + 1]])


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each sketch cell occur in the whole corpus, 65535 at most; partition sketches are merged
    block by block. A task ships each count as a byte, 255 at most."""

    def count(batches):
        total = np.zeros(1 << BITS, dtype=np.uint32)
        for b in batches:
            for _, _, raw, offs in common.text_slices(b):
                np.add.at(total, (_row_shingles(raw, offs, k)[0] >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
        if total.any():
            part = np.minimum(total, 255).astype(np.uint8).reshape(64, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([p.tobytes() for p in part], pa.binary())], ["block", "counts"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << BITS) // 64, dtype=np.int64)
        for c in f["counts"]:
            total += np.frombuffer(c, dtype=np.uint8)
        return pd.DataFrame({"block": f["block"].iloc[:1], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})

    out = np.zeros((64, (1 << BITS) // 64), dtype=np.uint16)
    for r in docs.select("text").mapInArrow(count, "block long, counts binary").groupBy("block").applyInPandas(merge, "block long, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, dtype="<u2")
    return out.reshape(-1)


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, digest (of the sorted set), node (its first 5 bytes), prefix (shingles that a similar set must share one of).

    Two sets with Jaccard similarity of percent / 100 or more share at least l of the first n - ceil(percent * n / 100) + l
    shingles of each in any common order, for every l; here l = max(1, n // DEPTH) of the smaller one. The order takes shingles of seldom-hit sketch cells first, so that passages which other documents share
    are seldom among the first; it only steers the work, never the result."""
    spark = docs.sparkSession
    freq = _frequencies(docs, k)
    shift = np.uint64(64 - BITS)
    counts = spark.sparkContext.broadcast(freq)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = counts.value
        for b in batches:
            n, digest, node, prefix = [], [], [], []
            for _, s in _sets(b, k):
                m = len(s)
                n.append(m)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                digest.append(d)
                node.append(int.from_bytes(d[:5], "little"))
                if m:
                    p = m - (percent * m + 99) // 100 + max(1, m // DEPTH)
                    s = s[np.argsort(table[(s >> shift).astype(np.int64)], kind="stable")[:p]]
                prefix.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(node, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "n", "digest", "node", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, digest binary, node long, prefix binary")


def _sorted(token: np.ndarray, *more: np.ndarray):
    o = np.lexsort((more[0], token))
    token = token[o]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return token, starts, np.diff(np.append(starts, len(token))), [x[o] for x in more]


def _spread(starts: np.ndarray, sizes: np.ndarray):
    """The places start .. start + size - 1 of every run, and the run of each."""
    run = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[run], run


def _pairs_of(node: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(a, b), a < b, of all nodes of each run; runs are short."""
    out = []
    for m in np.unique(sizes):
        at = starts[sizes == m]
        i, j = np.triu_indices(int(m), 1)
        out.append(np.stack([node[at[:, None] + i].ravel(), node[at[:, None] + j].ravel()], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of bytes of one place each: places that are zero in all of them take next to no room when compressed."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(rows) -> np.ndarray:
    return np.concatenate([np.zeros(0, "<u8"), *(np.ascontiguousarray(np.frombuffer(r, np.uint8).reshape(8, -1).T).view("<u8").ravel() for r in rows)])


def shared_at_least(m_a: Column, m_b: Column, percent: int) -> Column:
    """How many of their prefix shingles two similar sets of these sizes share at least.

    They have o = ceil(percent * (m_a + m_b) / (100 + percent)) shingles in common. Of the two prefixes take the one that ends first in the common order: at most
    m - p of its set's common shingles lie behind it, and the others are in the other prefix too."""
    both = F.floor((percent * (m_a + m_b) + 99 + percent) / F.lit(100 + percent))
    ahead = lambda m: F.greatest(F.lit(1), F.floor(m / DEPTH)) - F.floor((percent * m + 99) / 100)  # noqa: E731  p - m
    return F.greatest(F.lit(1), both + F.least(ahead(m_a), ahead(m_b)))


def _shared_prefixes(sig: DataFrame, cap: int, percent: int = 80, group_bytes: int = 4 << 20, fold_rows: int = 50_000_000) -> DataFrame:
    """a, b: edges that connect all sets which may be similar by their prefixes.

    The sets of a prefix shingle are counted pair by pair where there are at most `cap`; pairs whose sizes differ too much, or with
    fewer shared shingles than shared_at_least(), go. A shingle with more sets (a frequent one) connects them with its smallest one instead, without a count, so the work
    follows the number of sets either way. How many frequent shingles a set has is added to what its pairs share; a set with fewer of
    them than similar sets must share is not connected by them, as its pairs share others too. So nothing is lost. A batch ships each shingle's sets packed by hash range, or the
    smallest alone where it has more than `cap` itself. Where there are so many batches that even `cap` sets of one shingle from each
    would make a large group (from fold_rows rows on), they are merged in salted groups first, of which each again passes on a
    shingle's sets, or the smallest alone. The number of hash ranges follows the bytes of all prefixes, so a group holds
    about group_bytes at every size, and a shingle with a third of all rows is a few rows of it."""
    total, n_rows = sig.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)), F.count("*")).first()
    parts = max(common.partitions(sig.sparkSession), -(-2 * total // group_bytes))
    salts = 1 + n_rows // fold_rows
    step = np.uint64(2**64 // parts + 1)

    def folded(token, ids, flag):
        """Rows of packed sets and of star edges (set, smallest, number of shingles), from the sets (ids) of shingles (token) and whether others have gone before."""
        token, starts, sizes, (ids, flag) = _sorted(token, ids, flag)
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])])  # a set in two batches
        hot = np.logical_or.reduceat(flag, starts)
        token, ids, run = token[fresh], ids[fresh], np.repeat(np.arange(len(starts)), sizes)[fresh]
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sizes = np.diff(np.append(starts, len(run)))
        hot |= sizes > cap
        keep = np.repeat(~hot, sizes)
        keep[starts[hot]] = True
        at, r = _spread(starts[hot], sizes[hot])
        star, times = np.unique(np.stack([ids[at], ids[starts[hot][r]]], axis=1), axis=0, return_counts=True)
        star = np.concatenate([star, times[:, None]], axis=1)
        return token[keep], ids[keep], np.repeat(hot, sizes)[keep], star[star[:, 0] != star[:, 1]]

    def edge_row(star):
        return (int(star[0, 0] % parts), 0, _planes(star[:, 0]), _planes(star[:, 1]), _planes(star[:, 2]), True)

    def set_row(part, salt, token, ids, flag):
        return (part, salt, _planes(np.diff(token, prepend=np.uint64(0))), _planes(ids), flag.tobytes(), False)  # shingles are in order: small steps

    def pack(batches):
        for b in batches:
            node = np.array(b.column("node"), dtype=np.int64)
            _, one = np.unique(node, return_index=True)
            raw = [b.column("prefix")[int(i)].as_py() for i in one]
            size = np.array([len(r) // 8 for r in raw], dtype=np.int64)
            token = np.frombuffer(b"".join(raw), dtype="<u8")
            if not len(token):
                continue
            token, ids, flag, star = folded(token, np.repeat(node[one], size), np.zeros(len(token), bool))
            part = (token // step).astype(np.int64)
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            keys = part[np.concatenate([[0], cuts])]
            salt = int(node[0]) % salts
            rows = [set_row(int(k), salt, t, m, h) for k, t, m, h in zip(keys, np.split(token, cuts), np.split(ids, cuts), np.split(flag, cuts), strict=True)]
            if len(star):
                rows.append(edge_row(star))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["part", "salt", "x", "y", "hot", "edge"])

    def unpacked(f: pd.DataFrame):
        e, t = f[f["edge"]], f[~f["edge"]]
        star = np.stack([_unplaned(e[c]).astype(np.int64) for c in ("x", "y", "hot")], axis=1)
        token = np.concatenate([np.zeros(0, "<u8"), *(np.cumsum(_unplaned([x]), dtype=np.uint64) for x in t["x"])])
        return star, token, _unplaned(t["y"]).astype(np.int64), np.frombuffer(b"".join(t["hot"]), dtype=bool)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        star, token, ids, flag = unpacked(f)
        part = int(f["part"].iloc[0])
        rows = [edge_row(star)] if len(star) else []
        if len(token):
            token, ids, flag, star = folded(token, ids, flag)
            rows.append(set_row(part, 0, token, ids, flag))
            if len(star):
                rows.append(edge_row(star))
        return pd.DataFrame(rows, columns=["part", "salt", "x", "y", "hot", "edge"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        star, token, ids, flag = unpacked(f)
        out = [star * [1, 1, -1]]
        if len(token):
            token, ids, flag, star = folded(token, ids, flag)
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(starts, len(token)))
            few = ~flag[starts] & (sizes > 1)
            pair, times = np.unique(_pairs_of(ids, starts[few], sizes[few]), axis=0, return_counts=True)
            least, often = np.unique(ids[flag], return_counts=True)
            out += [star * [1, 1, -1], np.stack([least, least, -often], axis=1), np.concatenate([pair, times[:, None]], axis=1)]
        a, b, n = np.concatenate(out).T
        return pd.DataFrame({"a": a, "b": b, "n": n})

    packed = "part long, salt int, x binary, y binary, hot binary, edge boolean"
    found = sig.where("n > 0").select("node", "prefix").mapInArrow(pack, packed)
    if salts > 1:
        found = found.groupBy("part", "salt").applyInPandas(fold, packed)
    found = found.groupBy("part").applyInPandas(merge, "a long, b long, n long")
    found = common.saved(found, "prefix-pairs")
    star = found.where("n < 0 and a <> b").select("a", "b").distinct()
    hot = found.where("n < 0").groupBy(F.col("a").alias("node")).agg((-F.sum("n")).alias("hot"))  # too many where equal sets are in several batches
    passed = star.select(F.col("b").alias("node")).distinct().withColumn("passed", F.lit(True))  # others may hang on such a set
    nodes = sig.where("n > 0").groupBy("node").agg(F.min("n").alias("m"), F.max("n").alias("most")).join(hot, "node", "left").join(passed, "node", "left")
    nodes = common.saved(nodes.select("node", "m", (F.col("m") < F.col("most")).alias("mixed"), F.coalesce("hot", F.lit(0)).alias("hot"), F.coalesce("passed", F.lit(False)).alias("passed")), "nodes")
    pairs = found.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("m", "mixed", "hot")]), side)
    fit = 100 * F.least("m_a", "m_b") >= percent * F.greatest("m_a", "m_b")
    many = F.col("n") + F.least("hot_a", "hot_b") >= shared_at_least(F.col("m_a"), F.col("m_b"), percent)
    pairs = pairs.where(F.col("mixed_a") | F.col("mixed_b") | (fit & many))  # mixed: two sets with one node
    enough = F.greatest(F.lit(1), F.floor(F.floor(percent * F.col("m") / 100) / DEPTH))
    bound = star.join(nodes.where(F.col("mixed") | F.col("passed") | (F.col("hot") >= enough)).select(F.col("node").alias("a")), "a", "left_semi")
    return pairs.select("a", "b").unionByName(bound)


def linked_in_tile(ids: np.ndarray, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets of one tile: (id, id), at most one fewer than the sets. Sets marked as joined are known to be
    connected with one another, so only their links to the others are looked for.

    From each set in turn the not yet reached ones are tried: first by size, then by the bitmap bound (a bit that only one
    side has proves an element that the other lacks, so bit counts bound the overlap from above), then exactly. A set
    that is already connected needn't be tried again, so a tile of near copies costs about one comparison each."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    width = int(min(2048, max(64, 1 << int(np.ceil(np.log2(4 * max(1.0, float(np.median(n)))))))))
    bits = np.zeros((len(sets), width), dtype=bool)
    for i, s in enumerate(sets):
        bits[i, (s & np.uint64(width - 1)).astype(np.int64)] = True
    sig = np.packbits(bits, axis=1).view(np.uint64)
    del bits
    left = np.argsort(n, kind="stable")
    out, front = [], []
    if joined is not None:
        front, left = np.flatnonzero(joined).tolist(), left[~joined[left]]
    while len(left):
        if front:
            i = front.pop()
        else:
            i, left = int(left[-1]), left[:-1]
        m = n[left]
        fit = 100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])
        cand = left[fit]
        only_i = np.bitwise_count(sig[i] & ~sig[cand]).sum(1, dtype=np.int64)
        only_j = np.bitwise_count(sig[cand] & ~sig[i]).sum(1, dtype=np.int64)
        bound = np.minimum(n[i] - only_i, n[cand] - only_j)
        cand = cand[(100 + percent) * bound >= percent * (n[i] + n[cand])]
        hit = []
        for j in cand.tolist():
            a, b = (sets[i], sets[j]) if n[i] <= n[j] else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if (100 + percent) * both >= percent * (n[i] + n[j]):
                out.append((int(ids[i]), int(ids[j])))
                hit.append(j)
        if hit:
            front += hit
            left = left[~np.isin(left, hit)]
    return out


def _tile_links(base: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: the links of linked_in_tile() in each tile of placed (rep, digest, cluster, tile, joined)."""
    kind = base.schema["doc_id"].dataType.simpleString()
    placed = common.saved(placed, "tiles")

    def arrays(batches):
        for b in batches:
            ids, seen, rows, digests, items = b.column("doc_id").to_pylist(), set(), [], [], []
            for i, s in _sets(b, k):
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if (ids[i], d) not in seen:  # a repeated row
                    seen.add((ids[i], d))
                    rows.append(i)
                    digests.append(d)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(digests, pa.binary()), pa.array(items, pa.binary())], ["rep", "digest", "items"])

    def tile_links(f: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, dtype="<u8") for x in f["items"]]
        got = linked_in_tile(f["rep"].to_numpy(), sets, percent, f["joined"].to_numpy(dtype=bool))
        return pd.DataFrame(got, columns=["a", "b"], dtype=np.int64)

    texts = common.only_ids(base, placed.select(F.col("rep").alias("doc_id")))
    items = texts.mapInArrow(arrays, f"rep {kind}, digest binary, items binary")
    full = placed.join(items, ["rep", "digest"]).select("rep", "cluster", "tile", "joined", "items")
    return common.saved(full.groupBy("cluster", "tile").applyInPandas(tile_links, "a long, b long"), "links")


def _paired_tiles(rows: DataFrame, work, percent: int) -> DataFrame:
    """Tiles of rows (rep, digest, n, cluster, joined) in which each pair of which one row is not joined, and whose sizes may fit,
    meets: one tile for each pair of salted parts of the same or neighbouring size bands."""
    # band: sizes between neighbouring powers of 1 / share, so similar sets are in the same or the next band
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) - 1e-9).cast("int"))
    parts = lambda on: F.ceil(F.coalesce(F.sum(F.when(on, work)), F.lit(0.0))).cast("int")
    bands = common.saved(rows.groupBy("cluster", "band").agg(parts(F.col("joined")).alias("j0"), parts(~F.col("joined")).alias("r0")), "bands")
    for name, step in (("+", -1), ("-", 1)):
        near = bands.select("cluster", (F.col("band") + step).alias("band"), F.col("j0").alias(f"j{name}"), F.col("r0").alias(f"r{name}"))
        rows = rows.join(near, ["cluster", "band"], "left")
    rows = rows.join(bands, ["cluster", "band"])
    band, own = F.col("band"), F.when(F.col("joined"), F.col("j0")).otherwise(F.col("r0"))
    salt = F.pmod(F.xxhash64("digest"), own).cast("int")
    each = lambda c, f: F.when(F.coalesce(F.col(f"`{c}`"), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(f"`{c}`") - 1), f)).otherwise(F.array().cast("array<string>"))
    name = lambda kind, b1, s1, b2, s2: F.concat_ws(" ", F.lit(kind), b1, s1, b2, s2)
    steps = (("0", band), ("+", band + 1), ("-", band - 1))
    of_joined = F.concat(*[each(f"r{c}", lambda i: name("j", band, salt, other, i)) for c, other in steps])
    with_joined = [each(f"j{c}", lambda i: name("j", other, i, band, salt)) for c, other in steps]
    same = each("r0", lambda i: name("r", band, F.least(i, salt), band, F.greatest(i, salt)))
    above, below = each("r+", lambda i: name("r", band, salt, band + 1, i)), each("r-", lambda i: name("r", band - 1, i, band, salt))
    tiles = F.when(F.col("joined"), of_joined).otherwise(F.concat(same, above, below, *with_joined))
    return rows.select("rep", "digest", "cluster", F.explode(tiles).alias("tile"), "joined")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, tile_bytes: int = 16 << 20, tile_rows: int = 64, pair_rows: int = 512, guests: int = 8, cap: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text), exactly. Ids are integers.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct k-word shingles, or the whole sequence
    where there are fewer words; a shingle is a 64-bit hash that is finalised after every eight bytes and every word. Two
    documents link when 100 * intersection >= percent * union; component_id is the smallest doc_id that links reach. A null or empty text, or one without words, has no shingles and no link.

    1. Equal sets are one class (by a 128-bit digest). 2. Sets that share as many prefix shingles as similar ones
    must form clusters (shingles that more than `cap` sets have in their prefix connect all of these). 3. A cluster is one tile of
    about tile_bytes and tile_rows where it fits, else it is dealt over several, each with the same `guests` of its sets.
    In a tile, sizes, bitmap bounds and exact intersections give links enough to connect what is linked. 4. In clusters of several
    tiles only sets outside the largest component so far can still change anything: they are paired with all others, in
    tiles of salted parts (pair_rows rows) of the same or neighbouring size bands. So a family of near copies, even one with a third of all rows,
    costs about one comparison a set. 5. The components of all links are the result.

    Rows that share a doc_id count as one document; a null id gets a null component and no link. An empty table gives an
    empty result; other columns are not read."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    sig = common.saved(_signatures(base, k, percent), "sets")
    edges = _shared_prefixes(sig, cap, percent)
    clusters = common.components(edges)
    members = common.saved(clusters.select("node", "root").unionByName(clusters.select(F.col("root").alias("node"), "root")).distinct(), "clusters")
    classes = sig.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("node").alias("node"))
    classes = common.saved(classes, "classes")
    reps = common.saved(classes.join(members, "node").select("rep", "digest", "n", F.col("root").alias("cluster")), "reps")

    # work: the share of a tile that a row takes, by its bytes or as one of tile_rows
    work = F.greatest(F.col("n") * 8 / tile_bytes, F.lit(1 / tile_rows))
    large = reps.groupBy("cluster").agg(F.sum(work).alias("work")).where("work > 1").select("cluster", F.ceil("work").cast("int").alias("parts"))
    large = common.saved(large, "large")
    dealt = reps.join(large, "cluster", "left").withColumn("own", F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(1))).cast("int"))
    first = Window.partitionBy("cluster").orderBy("digest")
    guides = dealt.where("parts is not null").withColumn("r", F.row_number().over(first)).where(F.col("r") <= guests).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("tile <> own")
    cols = ["rep", "digest", "cluster", F.col("tile").cast("string").alias("tile"), F.lit(False).alias("joined")]
    links = _tile_links(base, dealt.withColumn("tile", F.col("own")).select(*cols).unionByName(guides.select(*cols)), k, percent)
    if not large.isEmpty():
        roots = common.components(links).select(F.col("node").alias("rep"), "root")
        rows = reps.join(large.select("cluster"), "cluster").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        rows = common.saved(rows, "joined")
        most = rows.groupBy("cluster", "root").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max(F.struct("m", "root")).alias("x")).select("cluster", F.col("x.root").alias("main"))
        rows = rows.join(most, "cluster").withColumn("joined", F.col("root") == F.col("main"))
        links = links.unionByName(_tile_links(base, _paired_tiles(rows, F.greatest(F.col("n") * 8 / tile_bytes, F.lit(1 / pair_rows)), percent), k, percent))
    joined = common.components(links)
    reach = classes.select("digest", "rep").join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("__c"))
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(reach, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("__c"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, less those whose component has a smaller doc_id. Rows with a null id stay."""
    found = near_duplicates(docs, k, percent).where("doc_id <> component_id").select("doc_id")
    return common.without_ids(docs, common.saved(found, "near"))
