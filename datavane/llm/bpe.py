"""Byte-level BPE over an index of pair occurrences, and a cached encoder for counting and packing."""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import same_bytes, text_slices, word_hashes

#: Text that is encoded at once; a longer text makes a group of its own.
GROUP_BYTES = 3 << 20
#: The white space of Unicode, as the pre-tokenizer's \s has it.
_WS = "\t-\r \x85\xa0  -     　"
_BLANKS = {c for lo, hi in re.findall("(.)-(.)", _WS) for c in map(chr, range(ord(lo), ord(hi) + 1))} | set(re.sub(".-.", "", _WS))
#: The published pre-tokenizer pattern of this family of vocabularies.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_AFTER_WS = np.zeros((256, 256), dtype=bool)
_AFTER_WS[:, [0x20, *range(0x09, 0x0E)]] = True
for _c in "".join(sorted(_BLANKS)):
    if not _c.isascii():
        _AFTER_WS[_c.encode()[-2], _c.encode()[-1]] = True


def chunk_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the texts in raw are cut: at their starts, and before each blank that follows ink. A pre-token never crosses
    such a cut and none looks past it, so the chunks can be encoded apart. (A few more bytes than white space count as
    white space, which only leaves out cuts.)"""
    at = np.flatnonzero(raw == 0x20)
    at = at[at > 0]
    last, but_last = raw[at - 1], raw[np.maximum(at - 2, 0)]
    cut = np.zeros(len(raw), dtype=bool)
    cut[at[~_AFTER_WS[but_last, last]]] = True
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(cut)


def special_tokens(path: str) -> dict[str, int]:
    """The tokens of a vocabulary file that keep their own id wherever they occur in a text."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, as its letter -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


class PairIndexBPE:
    """Encoder and decoder of one vocabulary file.

    encode_many() works on all distinct chunks of a partition at once: an index holds, for each pair that has a merge
    rank, the positions where it occurs. The active ranks are taken in ascending order; all occurrences of
    a pair are merged together, and the pairs that this creates are added to the lists of their own (later) ranks.
    An entry whose symbols have changed meanwhile is passed over."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, dtype=np.int32)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.width = np.int64(len(self.bytes_of) + 1)
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where it has none."""
        keys = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode_many(self, joined: bytes, sizes: np.ndarray, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, one after another, and how many each has. joined: UTF-8 of chunks that may stand in one
        string, with their sizes in bytes; others: chunks that may not, which come after them."""
        words = [_SPLIT.findall(joined.decode()), *map(_SPLIT.findall, others)]
        tails = [t.encode() for t in others]
        data = np.frombuffer(joined + b"".join(tails), dtype=np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(sizes) + len(others), np.int64)
        letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte offset of each code point
        start = letters[np.concatenate([[0], np.cumsum([len(w) for part in words for w in part])])]
        size, start = np.diff(start), start[:-1]
        chunk_ends = np.cumsum(np.concatenate([sizes, np.array([len(t) for t in tails], dtype=np.int64)]))
        sym = self.first[data]
        n = len(sym)
        nxt = np.arange(1, n + 1, dtype=np.int64)
        prv = np.arange(-1, n - 1, dtype=np.int64)
        nxt[start + size - 1], prv[start] = -1, -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            r = self.ranks(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            o = np.argsort(r, kind="stable")
            at, r = at[o], r[o]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for rank, piece in zip(r[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if rank in lists:
                    lists[rank].append(piece)
                else:
                    lists[rank] = [piece]
                    heapq.heappush(active, rank)

        add(np.flatnonzero(nxt >= 0))
        while active:
            rank = heapq.heappop(active)
            pieces = lists.pop(rank)
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            at = np.sort(np.concatenate(pieces)) if len(pieces) > 1 else pieces[0]
            after = nxt[at]
            ok = (after >= 0) & (sym[at] == a) & (sym[after] == b)
            at, after = at[ok], after[ok]
            if a == b and len(at) > 1 and (after[:-1] == at[1:]).any():  # overlaps go to the left one
                free, taken = [], -1
                for i, (x, y) in enumerate(zip(at.tolist(), after.tolist(), strict=True)):
                    if x != taken:
                        free.append(i)
                        taken = y
                at, after = at[free], after[free]
            if not len(at):
                continue
            beyond = nxt[after]
            sym[at], sym[after], nxt[at] = c, -1, beyond
            prv[beyond[beyond >= 0]] = at[beyond >= 0]
            before = prv[at]
            near = np.concatenate([before[before >= 0], at[beyond >= 0]])
            if len(near) > 1:
                near = np.sort(near)
                near = near[np.concatenate([[True], near[1:] != near[:-1]])]
            if len(near):
                add(near)
        live = sym >= 0
        upto = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(live, out=upto[1:])
        return sym[live].astype(np.uint32), np.diff(upto[np.concatenate([[0], chunk_ends])])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class ChunkEncoder:
    """ids of whole texts, for one task. Chunks are told apart by a 64-bit hash, and where two have the same, by all their
    bytes. The unseen ones of a group of texts are encoded together by encode_many and kept until there are `limit` of them."""

    def __init__(self, encode_many, special: dict[str, int], limit: int = 400_000):
        self.encode_many, self.special, self.limit = encode_many, special, limit
        self.splits = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._empty()

    def _empty(self) -> None:
        self.key, self.data = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.place, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _one(self, text: str) -> np.ndarray:
        """A chunk that holds a special token: its parts are encoded apart."""
        none = np.zeros(0, np.int64)
        parts = [x for x in self.splits.split(text) if x]
        return np.concatenate([np.array([self.special[x]], np.uint32) if x in self.special else self.encode_many(b"", none, [x])[0] for x in parts])

    def _many(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of the chunks raw[s:e], in one array; where each begins there; how many each has."""
        data = raw.tobytes()
        safe = (raw[s] == 0x20) & ~_AFTER_WS[raw[np.maximum(e - 2, 0)], raw[e - 1]]
        odd = np.zeros(len(s), dtype=bool)
        if any(x.encode() in data for x in self.special):
            odd = np.array([any(t.encode() in data[x:y] for t in self.special) for x, y in zip(s.tolist(), e.tolist(), strict=True)], dtype=bool)
        a, b = np.flatnonzero(safe & ~odd), np.flatnonzero(~safe & ~odd)
        size = e[a] - s[a]
        joined = _taken(raw, s[a], size).tobytes()
        flat, n = self.encode_many(joined, size, [data[x:y].decode() for x, y in zip(s[b].tolist(), e[b].tolist(), strict=True)])
        own = [self._one(data[s[i] : e[i]].decode()) for i in np.flatnonzero(odd)]
        order = np.concatenate([a, b, np.flatnonzero(odd)])
        n = np.concatenate([n, np.array([len(x) for x in own], dtype=np.int64)])
        flat = np.concatenate([flat, *own])
        begin = np.cumsum(n) - n
        back = np.argsort(order, kind="stable")
        return flat, begin[back], n[back]

    def _distinct(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of each distinct chunk, one chunk that has it, and the distinct chunk of each chunk."""
        key = word_hashes(raw, starts, starts + size)
        order = np.argsort(key, kind="stable")
        a, at, n = key[order], starts[order], size[order]
        again = np.flatnonzero(a[1:] == a[:-1])
        same = (n[again] == n[again + 1]) & same_bytes(raw, at[again], raw, at[again + 1], np.minimum(n[again], n[again + 1]))
        if same.all():
            new = np.concatenate([[True], a[1:] != a[:-1]])
            group = np.empty(len(order), dtype=np.int64)
            group[order] = np.cumsum(new) - 1
            return a[new], order[new], group
        data, seen = raw.tobytes(), {}  # a hash fell together: by the bytes themselves
        group = np.array([seen.setdefault(data[x : x + y], len(seen)) for x, y in zip(starts.tolist(), size.tolist(), strict=True)], dtype=np.int64)
        first = np.unique(group, return_index=True)[1]
        return key[first], first, group

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in raw, one after another, and where each text begins among them (and the end)."""
        starts = chunk_starts(raw, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        width = np.diff(np.append(starts, len(raw)))
        key, first, group = self._distinct(raw, starts, width)
        begin, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        seen, known = np.zeros(len(key), bool), np.zeros(len(key), bool)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = self.key[at] == key
            seen = known & (self.bytes[at] == width[first])
            some = np.flatnonzero(seen)
            seen[some] = same_bytes(self.data, self.place[at[some]], raw, starts[first[some]], self.bytes[at[some]])
            begin[seen], size[seen] = self.at[at[seen]], self.size[at[seen]]
        todo = np.flatnonzero(~seen)
        got, came, more = self._many(raw, starts[first[todo]], starts[first[todo]] + width[first[todo]])
        flat = np.concatenate([self.flat, got])
        begin[todo], size[todo] = len(self.flat) + came, more
        n = size[group]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[group] - upto[:-1], n) + np.arange(upto[-1])]
        if len(self.key) + len(todo) > self.limit:
            self._empty()
        else:
            keep = np.unique(key[todo], return_index=True)[1]  # of chunks with one hash, the first
            keep = todo[keep[~known[todo[keep]]]]
            keep = keep[np.argsort(key[keep], kind="stable")]
            where, wide = np.searchsorted(self.key, key[keep]), width[first[keep]]
            self.key = np.insert(self.key, where, key[keep])
            self.place = np.insert(self.place, where, len(self.data) + np.cumsum(wide) - wide)
            self.bytes = np.insert(self.bytes, where, wide)
            self.at, self.size = np.insert(self.at, where, begin[keep]), np.insert(self.size, where, size[keep])
            self.data, self.flat = np.concatenate([self.data, _taken(raw, starts[first[keep]], wide)]), flat
        return ids, upto[np.searchsorted(starts, offs, "left")]


def _taken(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after another."""
    return raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text (null: empty) of docs (doc_id, text).

    vocabulary: a tokenizer file that every executor can read. The ids equal those of the tokenizers library with
    add_special_tokens=False: special tokens that occur in a text keep their own id. Rows are encoded one by one:
    repeated rows, null ids and other columns change nothing; an empty table gives an empty result."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = PairIndexBPE(vocabulary)
        coder = ChunkEncoder(model.encode_many, model.special)
        for b in batches:
            for lo, n, raw, offs in text_slices(b, limit=GROUP_BYTES):
                ids, at = coder.encode(raw, offs)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, n), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of encoded (doc_id, ids): the bytes of the ids, read as UTF-8 with U+FFFD for what isn't."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = PairIndexBPE(vocabulary)
        for b in batches:
            texts = [model.decode(x or []).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256: encode() then decode() in one pass,
    so that neither the ids nor the decoded texts are moved. Same cases as encode()."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = PairIndexBPE(vocabulary)
        coder = ChunkEncoder(model.encode_many, model.special)
        names = [str(i) for i in range(len(model.bytes_of))]
        for b in batches:
            for lo, n, raw, offs in text_slices(b, limit=GROUP_BYTES):
                flat, at = coder.encode(raw, offs)
                one, two = [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = flat[x:y].tolist()
                    one.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    two.append(hashlib.sha256(model.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, n), pa.array(np.diff(at)), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
