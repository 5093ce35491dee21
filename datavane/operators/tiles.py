"""Records that share keys, met in tiles.

Records are numbers from 0. A list is what has one key: the numbers that ask and the numbers that can be met. Lists are cut by groups of askers and of
members (number modulo groups), packed in two bytes a number and dealt to tiles, one task each; a tile opens its lists source by source and counts with numpy.
So a number is shuffled once for each group of the other side, not once for each record that it meets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group's numbers fit two bytes; askers and members of a tile; groups of askers that are made for the sake of many tasks.
GROUP, ASKERS, MEMBERS, SPREAD = (1 << 16) - 1, 1 << 23, 1 << 25, 8
#: Values that are packed, or opened, at a time.
RUN = 1 << 20


def groups(n: int, entries: int) -> tuple[int, int]:
    """(groups of askers, groups of members) for n records and so many entries of lists."""
    up = lambda a, b: -(-a // b)
    return max(up(n, GROUP), up(entries, ASKERS), min(SPREAD, up(n, 256)), 1), max(up(n, GROUP), up(entries, MEMBERS), 1)


def _flat(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of lists of numbers."""
    at = a.offsets.to_numpy().astype(np.int64)
    return np.diff(at), a.values.to_numpy()[at[0] : at[-1]]


def _packed(lists: DataFrame, by: tuple[int, int]) -> DataFrame:
    """tile, k, n, body of lists (k int, askers array<int>, members array<int>, list long if they have numbers of their own): the lists of a tile that
    have both sides there."""
    s_groups, t_groups = by
    own_numbers = ["list"] if "list" in lists.columns else []

    def deal(batches):
        for b in batches:
            size = np.cumsum(_flat(b["askers"])[0] + _flat(b["members"])[0])
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + RUN, "right")))
                some, kinds = b.slice(lo, hi - lo), b["k"].slice(lo, hi - lo).to_numpy()
                rows = [x for k in np.unique(kinds) for x in one(some, kinds, int(k))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                lo = hi

    def one(b, ks, k):
        mine, n = ks == k, len(ks)
        sides = []
        for name, many in (("askers", s_groups), ("members", t_groups)):
            lens, values = _flat(b[name])
            row = np.repeat(np.arange(n), lens)
            group, own = values % many, (values // many).astype(np.uint16)
            at = [np.flatnonzero((group == g) & mine[row]) for g in range(many)]
            sides.append([(row[i], own[i], np.bincount(row[i], minlength=n)) for i in at])
        for s, (a_row, a, na) in enumerate(sides[0]):
            for t, (m_row, m, nm) in enumerate(sides[1]):
                keep = (na > 0) & (nm > 0)
                if keep.any():
                    body = b"".join(x.tobytes() for x in (na[keep].astype(np.uint16), nm[keep].astype(np.uint16), a[keep[a_row]], m[keep[m_row]], *(b[c].to_numpy()[keep] for c in own_numbers)))
                    yield {"tile": s * t_groups + t, "k": k, "n": int(keep.sum()), "body": body}

    shape = pa.schema([("tile", pa.int32()), ("k", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
    return lists.select("k", "askers", "members", *own_numbers).mapInArrow(deal, "tile int, k int, n int, body binary")


def _dealt(rows: DataFrame, by: tuple[int, int]) -> DataFrame:
    return rows.repartitionById(by[0] * by[1], F.col("tile"))


def _store(batches) -> dict[int, dict[int, list]]:
    """tile -> k -> (n, body) of all rows of a task."""
    out: dict[int, dict[int, list]] = {}
    for b in batches:
        for tile, k, n, body in zip(*(b[c].to_pylist() for c in ("tile", "k", "n", "body")), strict=True):
            out.setdefault(tile, {}).setdefault(k, []).append((n, body))
    return out


def _opened(parts: list, width: int, numbered: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(first source, source after the last, source * width + member for each member of each list of theirs, the list's own number for each of these if
    they have some), some sources at a time."""
    na, nm, a, m, own = ([] for _ in range(5))
    for n, body in parts:
        x = np.frombuffer(body, np.uint16)
        many, met = int(x[:n].sum(dtype=np.int64)), int(x[n : 2 * n].sum(dtype=np.int64))
        ends = 2 * n + many + met
        for out, cut in ((na, x[:n]), (nm, x[n : 2 * n]), (a, x[2 * n : 2 * n + many]), (m, x[2 * n + many : ends]), (own, np.frombuffer(body[2 * ends :], np.int64))):
            out.append(cut)
    na, nm, a, m, own = (np.concatenate(x) for x in (na, nm, a, m, own))
    order = np.argsort(a, kind="stable")
    key, a = np.repeat(np.arange(len(na), dtype=np.int32), na)[order], a[order]
    size = nm.astype(np.int32)
    start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    first = np.searchsorted(a, np.arange(int(a[-1]) + 2))
    cost = np.concatenate([[0], np.cumsum(size[key], dtype=np.int64)])[first]
    lo, last = 0, len(first) - 1
    while lo < last:
        hi = max(lo + 1, min(last, lo + max(1, (RUN << 2) // width), int(np.searchsorted(cost, cost[lo] + RUN, "right")) - 1))
        keys, row = key[first[lo] : first[hi]], a[first[lo] : first[hi]].astype(np.int64) - lo
        sizes = size[keys]
        at = np.repeat(start[keys] - (np.cumsum(sizes, dtype=np.int64) - sizes), sizes) + np.arange(sizes.sum())
        yield lo, hi, np.repeat(row * width, sizes) + m[at], np.repeat(own[keys], sizes) if numbered else None
        lo = hi


def hits(lists: DataFrame, n: int, entries: int, caps: dict[int, int]) -> DataFrame:
    """source, k, numbers: the distinct numbers that each source meets in the lists of a kind, ascending, of a kind in caps the first so many
    of each group of members only (several rows of one source and kind, if there are several groups)."""
    by = groups(n, entries)
    s_groups, t_groups = by
    width = -(-n // t_groups)

    def meet(batches):
        for tile, kinds in _store(batches).items():
            s, t = divmod(tile, t_groups)
            for k, parts in kinds.items():
                for lo, hi, flat, _ in _opened(parts, width):
                    seen = np.zeros((hi - lo) * width, bool)
                    seen[flat] = True
                    at = np.flatnonzero(seen)
                    row, number = np.divmod(at, width)
                    if k in caps:
                        keep = np.arange(len(row)) - np.searchsorted(row, row) < caps[k]
                        row, number = row[keep], number[keep]
                    source, ends = np.unique(row, return_index=True)
                    numbers = pa.ListArray.from_arrays(pa.array(np.append(ends, len(row)).astype(np.int32)), pa.array((number * t_groups + t).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(((source + lo) * s_groups + s).astype(np.int32)), pa.array(np.full(len(source), k, np.int32)), numbers], ["source", "k", "numbers"])

    return _dealt(_packed(lists, by), by).mapInArrow(meet, "source int, k int, numbers array<int>")


def _packed_pairs(pairs: DataFrame, by: tuple[int, int]) -> DataFrame:
    """The pairs (source int, target int) of each tile, in four bytes each."""
    s_groups, t_groups = by

    def deal(batches):
        for b in batches:
            a, m = b["source"].to_numpy(), b["target"].to_numpy()
            tile = a % s_groups * t_groups + m % t_groups
            both = np.stack([a // s_groups, m // t_groups], 1).astype(np.uint16)
            rows = [{"tile": int(x), "k": _PAIRS, "n": 0, "body": both[tile == x].tobytes()} for x in np.unique(tile)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("tile", pa.int32()), ("k", pa.int32()), ("n", pa.int32()), ("body", pa.binary())]))

    return pairs.select("source", "target").mapInArrow(deal, "tile int, k int, n int, body binary")


#: The kind of rows that hold pairs.
_PAIRS = -1


def _asked(of: dict[int, list], width: int) -> np.ndarray:
    """source * width + target of a tile's distinct pairs, ascending."""
    x = np.frombuffer(b"".join(body for _, body in of.pop(_PAIRS, [])), np.uint16).reshape(-1, 2).astype(np.int64)
    return np.unique(x[:, 0] * width + x[:, 1])


def counts(lists: DataFrame, pairs: DataFrame, n: int, entries: int, kinds: int) -> DataFrame:
    """source, target, s0, s1, ...: in how many lists of each kind (k from 0) the target of each distinct pair of pairs (source int, target int) is a
    member and the source asks."""
    by = groups(n, entries)
    s_groups, t_groups = by
    width = -(-n // t_groups)

    def meet(batches):
        for tile, of in _store(batches).items():
            s, t = divmod(tile, t_groups)
            asked = _asked(of, width)
            found = np.zeros((kinds, len(asked)), np.int32)
            for k, parts in of.items() if len(asked) else ():
                for lo, hi, flat, _ in _opened(parts, width):
                    i, j = np.searchsorted(asked, [lo * width, hi * width])
                    if i < j:
                        found[k, i:j] = np.bincount(flat, minlength=(hi - lo) * width)[asked[i:j] - lo * width]
            for i in range(0, len(asked), RUN // 8):
                row, number = np.divmod(asked[i : i + RUN // 8], width)
                cols = [(row * s_groups + s).astype(np.int32), (number * t_groups + t).astype(np.int32), *found[:, i : i + RUN // 8]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["source", "target", *[f"s{k}" for k in range(kinds)]])

    return _dealt(_packed(lists, by).unionByName(_packed_pairs(pairs, by)), by).mapInArrow(meet, ", ".join(["source int, target int", *[f"s{k} int" for k in range(kinds)]]))


def common(lists: DataFrame, pairs: DataFrame, n: int, entries: int) -> DataFrame:
    """source, target, list: the lists (k int, list long, askers, members; no two with one number) that each distinct pair of pairs (source int, target
    int) shares."""
    by = groups(n, entries)
    s_groups, t_groups = by
    width = -(-n // t_groups)

    def meet(batches):
        for tile, of in _store(batches).items():
            s, t = divmod(tile, t_groups)
            asked = _asked(of, width)
            for parts in of.values() if len(asked) else ():
                for lo, hi, flat, own in _opened(parts, width, True):
                    i, j = np.searchsorted(asked, [lo * width, hi * width])
                    want = np.zeros((hi - lo) * width, bool)
                    want[asked[i:j] - lo * width] = True
                    keep = want[flat]
                    row, number = np.divmod(flat[keep], width)
                    yield pa.RecordBatch.from_arrays([pa.array(((row + lo) * s_groups + s).astype(np.int32)), pa.array((number * t_groups + t).astype(np.int32)), pa.array(own[keep])], ["source", "target", "list"])

    return _dealt(_packed(lists, by).unionByName(_packed_pairs(pairs, by)), by).mapInArrow(meet, "source int, target int, list long")
