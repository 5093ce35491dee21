"""Filter interaction audit: what every order of five text filters removes, from one pass over the documents."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
#: The filters' letters in the order of the mask's bits; E (a copy of an earlier text) needs the whole table, the others a row.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text) -> dict:
    """The failure conditions A to D of a text, null as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACES), "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(t, F.lit("[A-Z]")) * 100 > F.length(t) * 10,
        "D": t.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of each part fail exactly the filters of the mask (bit 0 is A), and how
    many of these have a label quality 1, or toxic 1. At most 32 rows a part.

    A text stands for its SHA-256, so no text is shuffled; rows are counted per document before they meet the labels, and per text
    and part before the smallest doc_id of a text is looked for, so copies cost a row a task, not one each."""
    text = F.coalesce("text", F.lit(""))
    fails = failures(F.col("text"))
    mask = sum((F.when(fails[c], 1 << i).otherwise(0) for i, c in enumerate(FILTERS[:4])), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 1, false)").cast("int")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)").cast("int")).alias("toxic"))
    marks = marks.where("good + toxic > 0")
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    # of each text and part: all rows, and those of the smallest doc_id there (rows of one doc_id and text are one row by now)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("first")
    void = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"void_{c}") for c in ("n", "good", "toxic")]
    parts = rows.groupBy("digest", "part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], first, *void)
    least = parts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    parts = parts.join(least, "digest")
    is_first = F.col("first.doc_id") == F.col("least")  # else, and where all ids are null: nothing of this part is the first
    fine = {c: F.col(f"void_{c}") + F.when(is_first, F.col(f"first.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    both = F.array(F.struct("mask", *[v.alias(c) for c, v in fine.items()]), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), *[(F.col(c) - v).alias(c) for c, v in fine.items()]))
    flat = parts.select("part", F.inline(both)).where("n > 0")
    return flat.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _steps(order: str = "o") -> str:
    """SQL of the fold of a cell (mask, n, good, toxic) along an order of letters."""
    bit = f"shiftleft(1, instr('{FILTERS}', substring({order}, i, 1)) - 1)"
    fails = f"(mask & {bit}) <> 0"
    item = f"""named_struct('filter_order', {order}, 'step', i,
        'kept', if(a.gone or {fails}, 0L, n), 'removed', if(not a.gone and {fails}, n, 0L), 'redundant', if(a.gone and {fails}, n, 0L),
        'unique_fails', if(mask = {bit}, n, 0L), 'good_lost', if(not a.gone and {fails}, good, 0L), 'toxic_lost', if(not a.gone and {fails}, toxic, 0L))"""
    kind = "array<struct<filter_order:string,step:int," + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>"
    return f"""aggregate(sequence(1, {len(FILTERS)}), named_struct('gone', false, 'steps', cast(array() as {kind})),
        (a, i) -> named_struct('gone', a.gone or {fails}, 'steps', concat(a.steps, array({item}))), a -> a.steps)"""


def order_audit(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part of
    cells(), every order and every step, zeros included.

    The 120 orders are a literal array that goes with the plan. Each cell folds along each order (`aggregate`) and all orders
    (`transform`) into 600 structs weighted by its counts; the at most 32 arrays of a part are merged by elementwise sums. The
    Shapley value of a step is what its filter removes, summed over the merged 600 structs."""
    orders = "array(" + ", ".join(f"'{o}'" for o in ORDERS) + ")"
    folded = cells.select("part", F.expr(f"flatten(transform({orders}, o -> {_steps()}))").alias("steps"))
    added = ", ".join(f"'{c}', x.{c} + y.{c}" for c in _COUNTS)
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("all")).select(
        "part", F.expr(f"reduce(slice(all, 2, size(all)), all[0], (s, t) -> zip_with(s, t, (x, y) -> named_struct('filter_order', x.filter_order, 'step', x.step, {added})))").alias("steps")
    )
    letter = "substring({0}.filter_order, {0}.step, 1)"
    shapley = f"map_from_arrays(split('{','.join(FILTERS)}', ','), transform(split('{','.join(FILTERS)}', ','), f -> aggregate(filter(steps, x -> {letter.format('x')} = f), 0L, (s, x) -> s + x.removed)))"
    rows = merged.select("part", "steps", F.expr(shapley).alias("by_filter")).select("part", "by_filter", F.inline("steps"))
    return rows.select("part", "filter_order", "step", *_COUNTS, F.expr("by_filter[substring(filter_order, step, 1)]").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """order_audit() of docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    Null texts are empty, a null lang is the part of the empty string. A row with a null doc_id fails E never and makes no other row
    fail it; of rows that share text and smallest doc_id none fails E. A document with several label rows has a label if one
    of them says so. An empty table gives an empty result; other columns aren't read."""
    return order_audit(cells(docs, labels))
