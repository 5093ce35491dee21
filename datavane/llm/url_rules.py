"""Allow and block rules for URLs by a sort-merge range join on reversed-host keys."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """(host, path) columns. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path:
    from there up to `?`, `#` or the end. A null url, or one without `://`, has an empty host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UP, _LOW), path


def _host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def url_verdicts(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each url: id, host, path, rule, verdict.

    rules: host, path, verdict. A rule fits its host and every subdomain whose path starts with the rule's path;
    the longest host + path wins, then the longest host, then the smaller verdict. `rule` is host || path, null where
    none fits; the verdict is then `default`.

    Reversed host labels ("com.example.www.") turn "host and its subdomains" into a key prefix, so each rule is an
    interval of keys. Split points from a bounded sample cut the key space into buckets; a url falls into one bucket, a
    rule is copied into those that its interval meets. In each sorted bucket one sweep keeps the stack of rule hosts
    whose interval is open, so a url is compared with its own ancestors only. The key ends in the path and a hash of the
    id, hence a host, or one url, with a third of all rows is spread over many buckets.

    Null urls, ids and repeated rows are judged like any other; an empty table gives an empty result; rules with a null
    are ignored; other columns of both tables are not read."""
    spark = urls.sparkSession
    host, path = url_parts(F.col("__u"))
    base = urls.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__u")).select("__id", host.alias("host"), path.alias("path"))
    salt = F.lpad(F.hex(F.xxhash64(F.col("__id"))), 16, "0")
    base = base.withColumn("__key", F.concat(_host_key(F.col("host")), F.lit("\x01"), "path", F.lit("\x01"), salt))
    n = 8 * common.partitions(spark)  # several buckets a task, so that tasks come out even
    # 32 keys a bucket, cut to 200 characters: they only steer the balance, never the result
    sample = base.select(F.substring("__key", 1, 200).alias("k"), salt.alias("o")).select("k", F.xxhash64("k", "o").alias("o"))
    # about twice as many rows pass by their hash, so that what all tasks send doesn't grow with their number
    top = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 64 * n / max(1, urls.count()))))
    sample = sample.where(F.col("o") <= top).orderBy("o").limit(32 * n)
    keys = sorted(r.k for r in sample.collect())
    splits = sorted({keys[i] for i in range(32, len(keys), 32)})

    def dealt(frames):
        for f in frames:
            f["__b"] = [bisect.bisect_right(splits, k) for k in f["__key"]]
            yield f

    id_type = base.schema["__id"].dataType.simpleString()
    left = base.mapInPandas(dealt, f"__id {id_type}, host string, path string, __key string, __b int")
    left = left.select("__b", "__key", F.lit(1).alias("__kind"), "__id", "host", "path", F.lit(None).cast("string").alias("verdict"))

    def copied(frames):
        for f in frames:
            lo = [bisect.bisect_right(splits, k) for k in f["__key"]]
            hi = [bisect.bisect_right(splits, k + "\U0010ffff") for k in f["__key"]]
            f["__b"] = [list(range(a, b + 1)) for a, b in zip(lo, hi, strict=True)]
            yield f

    right = rules.select("host", "path", "verdict").dropna().select(_host_key(F.translate("host", _UP, _LOW)).alias("__key"), F.translate("host", _UP, _LOW).alias("host"), "path", "verdict")
    right = right.mapInPandas(copied, "__key string, host string, path string, verdict string, __b array<int>")
    right = right.select(F.explode("__b").alias("__b"), "__key", F.lit(0).alias("__kind"), F.lit(None).cast(id_type).alias("__id"), "host", "path", "verdict")

    def sweep(frames):
        bucket, stack = None, []  # stack: (key, {path: (host, verdict)}, path lengths)
        for f in frames:
            out = []
            for b, key, kind, i, host, path, verdict in f.itertuples(index=False, name=None):
                if b != bucket:
                    bucket, stack = b, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, set()))
                    own = stack[-1][1]
                    if path not in own or verdict < own[path][1]:
                        own[path] = (host, verdict)
                    stack[-1][2].add(len(path))
                    continue
                best = None
                for _, own, lengths in stack:  # outer hosts first: of equal lengths the longer host wins
                    for size in lengths:
                        if size <= len(path) and (hit := own.get(path[:size])) and (best is None or len(hit[0]) + size >= best[0]):
                            best = (len(hit[0]) + size, hit[0] + path[:size], hit[1])
                out.append((i, host, path, best[1] if best else None, best[2] if best else default))
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"]).astype({"id": f["__id"].dtype if len(out) == 0 else object})

    dealt_out = left.unionByName(right).repartition(common.partitions(spark), "__b").sortWithinPartitions("__b", "__key", "__kind")
    out = dealt_out.mapInPandas(sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
