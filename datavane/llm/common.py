"""Helpers shared by the corpus operators: scratch tables, joins by id, key ranges, and words of whole Arrow batches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09-0x0D, the white space of every word contract here.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rows of a broadcast table of keys: 2**20, about 60 MB in a JVM. A larger one is joined by a shuffle.
MAX_KEYS = 1 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master, as in tests, may do without: its one machine
    then gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="datavane-"))
    return named.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/datavane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_POW: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text asks for it."""
    have = _POW.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        step[0] = 1
        have = _POW[key] = np.multiply.accumulate(step)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the high and low bits are both usable."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """(first row, rows, UTF-8 bytes, offsets) of runs of rows with about `limit` bytes; nulls are empty.

    One very long text makes a run of its own, so memory follows the longest single text."""
    got = batch.column(batch.schema.get_field_index(column)).fill_null("")
    if pa.types.is_large_string(got.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = got.buffers()
    n = len(got)
    if n == 0:
        return
    offs = np.frombuffer(off, dtype=kind)[got.offset : got.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi - lo, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    pa.default_memory_pool().release_unused()  # a worker lives on for later stages


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` and the row that each belongs to."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[raw]
    edge = offs[(offs > 0) & (offs < len(raw))]
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    before[edge] = False
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


#: Spans up to this many bytes are read eight bytes at a time; longer ones one by one.
_LONG = 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place of raw, as one number; zeros follow its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; fold=True takes A-Z as a-z.

    Each eight bytes go through a whole finaliser, so that, unlike in a polynomial, no pattern of letters cancels out; spans
    over 64 bytes are hashed by BLAKE2b. Spans of one length up to eight bytes never collide."""
    if fold:
        raw = _LOWER[raw]
    size = ends - starts
    out = (size.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    eights = _eights(raw)
    at, left, some = starts, size, None
    done = 0
    while done < _LONG and len(at):
        h = mixed((out if some is None else out[some]) ^ (eights[at] & _MASK[np.minimum(left, 8)]))
        if some is None:
            out, some = h, np.arange(len(h))
        else:
            out[some] = h
        done += 8
        more = (left > 8) & (size[some] <= _LONG)
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_bytes(a: np.ndarray, a0: np.ndarray, b: np.ndarray, b0: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the `size` bytes of a from a0 those of b from b0?"""
    ok = np.ones(len(size), dtype=bool)
    x, y = _eights(a), _eights(b)
    some = np.flatnonzero((size > 0) & (size <= _LONG))
    done = 0
    while len(some):
        mask = _MASK[np.minimum(size[some] - done, 8)]
        ok[some] &= (x[a0[some] + done] & mask) == (y[b0[some] + done] & mask)
        done += 8
        some = some[size[some] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        ok[i] = np.array_equal(a[a0[i] : a0[i] + size[i]], b[b0[i] : b0[i] + size[i]])
    return ok


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words from the words' hashes, finalised word by word; for short runs."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = mixed(out + h[i : i + n])
    return out


_M = np.uint64(0xBF58476D1CE4E5B9)
_M_INV = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))


def rolling_sums(h: np.ndarray) -> np.ndarray:
    total = np.empty(len(h) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(h * powers(len(h), _M, "m"), out=total[1:])
    return total


def grams(total: np.ndarray, k: int) -> np.ndarray:
    """A quick hash of every run of k words, from rolling_sums(). Equal runs have equal hashes; it steers work, and nothing takes
    runs for equal because of it."""
    n = len(total) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed((total[k:] - total[:-k]) * powers(n, _M_INV, "mi"))


def with_ranges(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows with `bin`: the number of the range of the keys, in ascending order (nulls first), that a row falls into.

    Spark's own range partitioning of the keys alone gives the ranges' first keys, one row a range, which are written; a row
    finds its range among them by a coarse and a fine look-up. These first keys pass the driver as literals of the plan, one a range."""
    lows = rows.select(*keys).repartitionByRange(n, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("lo"))
    every = saved(lows.select("lo"), "ranges").agg(F.array_sort(F.collect_list("lo")).alias("lows"))
    wide = max(1, round(n**0.5))
    found = rows.withColumns({"__fine": every.scalar(), "__coarse": every.select(F.filter("lows", lambda c, i: i % wide == 0)).scalar()})
    key = F.struct(*keys)
    low = F.greatest(F.lit(0), F.size(F.filter("__coarse", lambda c: c <= key)) - 1) * wide
    place = low + F.size(F.filter(F.slice("__fine", low + 1, F.lit(wide)), lambda c: c <= key))
    return found.withColumn("bin", place.cast("int")).drop("__fine", "__coarse")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an undirected edge list reaches.

    Alternates large-star and small-star rounds (Kiveris et al. 2014), so the number of rounds follows the
    logarithm of the size, not the diameter; each round is written to the shared folder. Only a minimum per node
    is aggregated, so a hot node is combined before the shuffle, and its join is open to skew splitting."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, last = saved(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = saved(small, "stars")
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == last or mark[0] == 0:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def few_keys(keys: DataFrame) -> DataFrame | None:
    """The distinct rows of keys, marked for a broadcast, if they are MAX_KEYS at most; else None."""
    keys = keys.distinct()
    return F.broadcast(keys) if keys.count() <= MAX_KEYS else None


def left_by_id(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs, left-joined with a written table (doc_id, ...). Where its ids are few, a broadcast of their hashes tells which rows
    need the join, and the texts of the others aren't shuffled; else all are."""
    key = F.xxhash64("doc_id")
    hit = few_keys(table.select(key.alias("__key")))
    if hit is None:
        return docs.join(table, "doc_id", "left")
    rows, more = docs.withColumn("__key", key), [c for c in table.columns if c != "doc_id"]
    clean = rows.join(hit, "__key", "left_anti").drop("__key")
    maybe = rows.join(hit, "__key", "left_semi").drop("__key").join(table, "doc_id", "left").select(*docs.columns, *more)
    return clean.select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in more]).unionByName(maybe)


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in a written table ids (doc_id), and perhaps a few others."""
    key = F.xxhash64("doc_id")
    hit = few_keys(ids.select(key.alias("__key")))
    if hit is None:
        return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.withColumn("__key", key).join(hit, "__key", "left_semi").drop("__key")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in a written table ids (doc_id); rows with a null id stay."""
    marked = left_by_id(docs, ids.select("doc_id").distinct().withColumn("__gone", F.lit(True)))
    return marked.where("__gone is null").drop("__gone")
