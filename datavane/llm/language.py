"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LETTER: list[np.ndarray] = []
_B = np.uint64(21)


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def gram_counts(text: str, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams (n = 1 to 3, lower case, words padded by one blank) of the whole text, with counts.

    A gram is one integer, 21 bits a code point, so no two grams collide. Pieces of a very long text overlap by the
    length of a gram and their counts are merged."""
    parts = []
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    gap = codes == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first of a run of gaps
    codes = codes[keep]
    if len(codes) and codes[0] != 0:
        codes = np.concatenate([np.zeros(1, np.uint64), codes])
    if len(codes) and codes[-1] != 0:
        codes = np.concatenate([codes, np.zeros(1, np.uint64)])
    codes = codes + np.uint64(1)  # a blank is 1
    for lo in range(0, len(codes), piece):
        c = codes[lo : lo + piece + 2]
        one = c[:piece]
        one = one[one != 1]
        a, b = c[:-1][:piece], c[1:][:piece]
        two = a | (b << _B)
        x, y, z = c[:-2][:piece], c[1:-1][:piece], c[2:][:piece]
        three = (x | (y << _B) | (z << (_B + _B)))[y != 1]
        parts.append(np.unique(np.concatenate([one, two, three]), return_counts=True))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent grams, most frequent first; ties by the gram."""
    return grams[np.argsort(-counts.astype(np.int32), kind="stable")[:k]]


def learn(docs: DataFrame, k: int = 400, train_rows: int = 20_000) -> dict[str, np.ndarray]:
    """The profile of each language: its k most frequent grams over a bounded sample of labelled rows.

    docs: doc_id, text, lang. Rows with a null or empty text or a null lang teach nothing. train_rows is the documented
    bound: about that many rows are kept, by a hash of doc_id. Counts are summed in Spark; k grams a language reach the
    driver."""
    rows = docs.where("lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))

    def count(frames):
        total: dict[str, list] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"], strict=True):
                total.setdefault(lang, []).append(gram_counts(text))
        for lang, parts in total.items():
            grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(grams))
            yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": sums.astype(np.int64)})

    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    sums = rows.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("lang", "gram", "r").collect()
    out: dict[str, list] = {}
    for row in sorted(kept, key=lambda r: (r.lang, r.r)):
        out.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(grams, dtype=np.int64).astype(np.uint64) for lang, grams in out.items()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], k: int = 400) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    The k most frequent grams of the text, in order, are compared with each profile: a gram costs the distance between
    its two ranks, k when the profile lacks it. The smallest sum wins, ties go to the smaller language name. score = 1 -
    sum / (k * grams compared), from 0 to 1. A text that is null or has no letter is `und` with score 0, as is every
    text when nothing was learned. Rows are judged one by one, so repeated rows, null ids and other columns change
    nothing, and an empty table gives an empty result."""
    judge = _judge(profiles, k)

    def run(batches):
        for b in batches:
            got = [judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], k: int = 400, min_score: float = 0.0) -> DataFrame:
    """The rows of docs, with all their columns, that identify() gives a language with a score of min_score or more; where
    nothing was learned, so that every text is `und`, the rows that have a letter."""
    judge = _judge(profiles, k)

    def keep(text):
        if not profiles:
            return bool(text) and len(gram_counts(text)[0]) > 0
        lang, score = judge(text)
        return lang != "und" and score >= min_score

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([keep(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _judge(profiles: dict[str, np.ndarray], k: int):
    """text -> (language, score)."""
    langs = sorted(profiles)
    every = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.uint64)
    ranks = np.full((len(every) + 1, len(langs)), -1, dtype=np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(every, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def judge(text):
        grams, counts = gram_counts(text) if text else (every[:0], None)
        if not len(grams) or not langs:
            return "und", 0.0
        mine = top(grams, counts, k)
        at = np.searchsorted(every, mine)
        at[at == len(every)] = 0
        at = np.where(every[at] == mine, at, len(every))
        other = ranks[at]
        far = np.where(other < 0, k, np.minimum(k, np.abs(other - np.arange(len(mine), dtype=np.int32)[:, None]))).sum(0)
        best = int(np.argmin(far))
        return langs[best], float(1 - far[best] / (k * len(mine)))

    return judge


def held_out(doc_id):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
