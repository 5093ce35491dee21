"""Repair of conversation structure: signatures of roles and faults, one suffix-shared automaton, and the cheapest edits."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

_INK = "[^\\x20\\x09-\\x0D]"
_ROLES, _FAULTS = "suao", "nbdt"  # system, user, assistant, any other initial; none, blank, duplicate, truncated
#: A letter of a signature stands for a role's initial and a fault.
LETTERS = {(r, f): chr(65 + 4 * i + j) for i, r in enumerate(_ROLES) for j, f in enumerate(_FAULTS)}
#: For the cheapest edits blank and duplicate rows are alike, whatever their role: all are deleted.
_ALL = "".join(LETTERS.values())
_LEAST = "".join("X" if f in "bd" else c for (r, f), c in LETTERS.items())
_MEANS = {c: ("", False) if f in "bd" else (r, f == "t") for (r, f), c in zip(LETTERS, _LEAST, strict=True)}
#: The grammar (s?(ua)+)? : 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end. What a state does with a role, and
#: the state that the only user or assistant row it takes leads to.
_MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FORCED = (2, 2, 3, 2)
_END = ((0, "", 0), (6, "II", 3), (3, "I", 3), (0, "", 3))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of all conversation rows after the damage that crc32 of `conv_id:turn` modulo 20 chooses:
    0 drops the row (copies 0), 1 empties the text, 2 takes its `.!?` out, 3 repeats the row (copies 2), 4 sets the role user.
    A null counts as one space in the key, the role and the text."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]+", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _signed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, fault (n, b or t), n of rows without their texts; equal rows of one turn become one."""
    text = F.col("text")
    fault = F.when(~text.rlike(_INK), "b").when(text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "n").otherwise("t")
    slim = rows.where("copies > 0").select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), fault.alias("fault"), "copies")
    return slim.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n"))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature of every conversation that has rows: a letter (LETTERS) for each row, ordered by turn (nulls first), then
    role, then the text's SHA-256.

    A row is a duplicate if its conversation has its role and text before. Rows are dealt by conversation, role and text for that,
    and by ranges of the order for the letters, so a conversation of very many rows is spread over tasks; each task gives one
    run of letters for each conversation in its range, and only these runs (a byte a row) come together."""
    spark = rows.sparkSession
    once = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    slim = _signed(rows).withColumn("first", F.row_number().over(once) == 1)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault") == "b", "b")
    one, more = F.concat(initial, F.coalesce(code, F.when(F.col("first"), F.col("fault")).otherwise("d"))), F.concat(initial, F.coalesce(code, F.lit("d")))
    slim = common.saved(slim.select("conv_id", "turn", "role", "digest", "n", one.alias("one"), more.alias("more")), "turns")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    kind = slim.schema["conv_id"].dataType

    def runs(batches):
        now, letters, began = None, [], False
        ids = []

        def close():
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ids], ids_type), pa.array([x for _, x in ids], pa.string())], ["conv_id", "run"])

        ids_type = None
        for b in batches:
            ids_type = b.schema.field("conv_id").type
            for conv, n, one, more in zip(b["conv_id"].to_pylist(), b["n"].to_pylist(), b["one"].to_pylist(), b["more"].to_pylist(), strict=True):
                if not began or conv != now:
                    if began:
                        ids.append((now, "".join(letters)))
                    now, letters, began = conv, [], True
                letters.append(LETTERS[one[0], one[1]] + LETTERS[more[0], more[1]] * (n - 1))
            if ids:
                yield close()
                ids = []
        if began:
            ids = [(now, "".join(letters))]
            yield close()

    ranged = slim.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "n", "one", "more")
    parts = ranged.mapInArrow(runs, f"conv_id {kind.simpleString()}, run string").withColumn("part", F.spark_partition_id())
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "run"))).alias("runs"))
    return whole.select("conv_id", F.array_join(F.transform("runs", lambda r: r["run"]), "").alias("signature"))


def grown(letter: str, ahead: tuple) -> tuple:
    """The node of a row before a node: for each grammar state its cost-to-go, the audit letters up to and with the row, and the state after it.

    Of equal costs the ASCII-least letters win; they differ in their first letters, so the rest of the audit never decides."""
    role, cut = _MEANS[letter]
    cut = 3 * cut
    base = []
    for q in range(4):
        best = (4 + ahead[q][0], "D", q)
        if role:
            if (to := _MOVES.get((q, role))) is not None:
                best = min(best, (cut + ahead[to][0], "K", to))
            best = min(best, (3 + cut + ahead[_FORCED[q]][0], "R", _FORCED[q]))
        base.append(best)
    node = []
    for q in range(4):
        best, at = base[q], q
        for inserts in (1, 2):  # a third one would come back to a state that was there for less
            at = _FORCED[at]
            cost, letters, to = base[at]
            best = min(best, (3 * inserts + cost, "I" * inserts + letters, to))
        node.append(best)
    return tuple(node)


def audits(least: DataFrame) -> DataFrame:
    """least, cost, audit of every row of least (least: a distinct signature in which blank and duplicate rows are X).

    The automaton shares suffixes: a node is a distinct suffix of a signature, of any conversation. Signatures are sorted from
    their ends and dealt by ranges, so those that share a suffix are neighbours, and the nodes of the present one
    form a stack; what the next one shares with it stays. So a node's cost-to-go and best audit suffix (its letters and a link to the
    node behind) are worked out once for each grammar state, except for the nodes at the ranges' borders (once for each
    range); memory follows the longest signature."""
    spark = least.sparkSession
    back = F.reverse("least").alias("back")
    kind = "least string, cost long, audit string"

    def walk(batches):
        path, nodes = "", [_END]
        for b in batches:
            out = []
            for s in b["back"].to_pylist():
                low, high = 0, min(len(s), len(path))
                while low < high:  # how much of the ends is shared, by halving
                    mid = (low + high + 1) // 2
                    if s[low:mid] == path[low:mid]:
                        low = mid
                    else:
                        high = mid - 1
                del nodes[low + 1 :]
                for c in s[low:]:
                    nodes.append(grown(c, nodes[-1]))
                path = s
                q, audit = 0, []
                for node in reversed(nodes):
                    _, letters, q = node[q]
                    audit.append(letters)
                out.append((s[::-1], nodes[-1][0][0], "".join(audit)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["least", "cost", "audit"])

    return least.select(back).repartitionByRange(common.partitions(spark), "back").sortWithinPartitions("back").mapInArrow(walk, kind)


def structure(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation in damaged(); zeros and an empty audit
    for those without rows."""
    spans = _signed(rows).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    found = signatures(rows).withColumn("least", F.translate("signature", _ALL, _LEAST))
    found = common.saved(found, "signatures")
    least = common.saved(found.select("least").distinct(), "least")  # written, since ranges read it twice
    found = found.join(common.saved(audits(least), "audits"), "least")

    def faults(f):
        keep = "".join(c for (_, x), c in LETTERS.items() if x == f)
        return F.length(F.regexp_replace("signature", f"[^{keep}]+", "")).cast("long").alias({"b": "blank", "d": "duplicate", "t": "truncated"}[f])

    roles = F.translate("signature", _ALL, "".join(r for r, _ in LETTERS))
    legal = F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    found = found.select(F.col("conv_id").alias("id"), *[faults(f) for f in "bdt"], (F.greatest(F.length(roles) - 1, F.lit(0)) - legal).cast("long").alias("illegal"), "cost", "audit")
    every = rows.select("conv_id").distinct()
    out = every.join(found, every.conv_id.eqNullSafe(found.id), "left").drop("id")
    spans = spans.select(F.col("conv_id").alias("id"), (F.col("hi") - F.col("lo") + 1 - F.col("n")).alias("gaps"))
    out = out.join(spans, out.conv_id.eqNullSafe(spans.id), "left").drop("id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows of all conversations: conv_id, place (from 1), role, text; and at place 0 a row with what structure() found
    (found). The rows of a conversation follow one another in one partition, in order of their place.

    Each conversation's audit goes before its rows in the sort, and rows are read one by one, so memory follows the audit, a letter
    a row. The texts are shuffled once; one task reads a conversation, since a digest of it has to."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    head = found.select("conv_id", F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.unhex(F.lit("")).alias("digest"), F.lit(1).alias("copies"), *_HEAD)
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in _HEAD])
    order = [F.col("conv_id").asc_nulls_first(), F.col("is_row"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).drop("turn", "digest")

    def apply(batches):
        conv, audit, at, place, last = None, "", 0, 0, ""
        for b in batches:
            out = []

            def put(role, text):
                nonlocal place, last
                place, last = place + 1, role[:1]
                out.append((conv, place, role, text, *[None] * len(_HEAD)))

            def inserts():
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put("assistant" if last == "u" else "user", "")
                    at += 1

            for r in b.to_pylist():
                if not r["is_row"]:
                    conv, audit, at, place, last = r["conv_id"], r["audit"], 0, 0, ""
                    out.append((conv, 0, None, None, *[r[c] for c in _HEAD]))
                    inserts()
                    continue
                for _ in range(r["copies"]):
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        put(r["role"] if edit == "K" else "assistant" if last == "u" else "user", r["text"])
                    inserts()
            types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], ["conv_id", "place", "role", "text", *_HEAD])

    return both.mapInArrow(apply, f"conv_id {kind}, place long, role string, text string, " + ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _HEAD))


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation in rows, a table of
    damaged() (conv_id, turn, role, text, copies).

    Each row's first fault counts: blank, duplicate (role and text seen earlier), truncated. Rows come by turn, nulls first; rows
    of one turn by role, then by the SHA-256 of the text. The edits are the cheapest that give the roles' initials `(s?(ua)+)?`,
    of equal ones the ASCII-least: K keep 0, R another role 3, D delete 4, I insert an empty row 3; blank and duplicate rows
    must go, and a truncated row that stays costs 3. Null conv_ids are one conversation. A conversation whose rows were all dropped
    gets zeros, an empty audit and the hash of nothing; an empty table gives an empty result; other columns are not read."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        head, sha, names = None, None, ["conv_id", *_HEAD, "repaired_sha256"]
        types = None

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for b in batches:
            types = [b.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            done = []
            for r in b.to_pylist():
                if r["place"] == 0:
                    if head is not None:
                        done.append((*head, sha.hexdigest()))
                    head, sha = [r["conv_id"], *[r[c] for c in _HEAD]], hashlib.sha256()
                else:
                    sha.update(f"{chr(10) if r['place'] > 1 else ''}{r['role']}:{r['text']}".encode())
            if done:
                yield batch(done)
        if head is not None:
            yield batch([(*head, sha.hexdigest())])

    found = common.saved(structure(rows), "structure")
    return repaired(rows, found).mapInArrow(digest, f"conv_id {kind}, " + ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _HEAD) + ", repaired_sha256 string")
