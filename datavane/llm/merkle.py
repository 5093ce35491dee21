"""Merkle fingerprints of documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: A leaf: from 60 characters on, up to the first word that ends in a, e or o; 300 characters where there is none in 240.
LEAF = "(?s).{60,240}?[aeo] |.{1,300}"


def tree(text: Column) -> Column:
    """array<section: array<paragraph: array<leaf hash>>>. Sections are parted by an empty line, paragraphs by a line break;
    leaves are runs of words that end where their own letters say, so texts that agree from some place on soon share
    leaves again. Putting leaves and line breaks together restores the text, so equal trees are equal texts."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda s: F.sha2(s, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def _node(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def fingerprint(nodes: Column) -> Column:
    """root|section:paragraph.leaf.leaf,paragraph.leaf|section:...

    A node is the SHA-256 of its children's; the root has all 64 digits, a branch or leaf its first 12. Roots test equality;
    where they differ, comparing branches of equal position leads down to the edited leaves, as with_first_edit() does."""
    para = lambda p: F.concat(F.substring(_node(p), 1, 12), F.lit("."), F.array_join(F.transform(p, lambda x: F.substring(x, 1, 12)), "."))
    section_node = lambda s: _node(F.transform(s, _node))
    section = lambda s: F.concat(F.substring(section_node(s), 1, 12), F.lit(":"), F.array_join(F.transform(s, para), ","))
    return F.concat(_node(F.transform(nodes, section_node)), F.lit("|"), F.array_join(F.transform(nodes, section), "|"))


def leaf_set(nodes: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(F.flatten(nodes)), lambda x: F.substring(x, 1, 12)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared distinct leaves over all distinct leaves of both, from 0 to 1; 1 for equal fingerprints."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / both)


def with_first_edit(df: DataFrame, a: str, b: str, name: str = "first_edit") -> DataFrame:
    """df with section.paragraph.leaf (each from 0) of the first place where the fingerprints in columns a and b part, null for
    equal ones: the first section whose nodes differ, in it the first paragraph, in that the first leaf. Branches with equal
    nodes are not looked into. Each level is a step of its own, so that what it finds is worked out once."""
    whole = df.columns
    node = lambda x: F.substring(x, 1, 12)
    d = df.withColumns({"__x": F.substring(a, 66, 1 << 30), "__y": F.substring(b, 66, 1 << 30)})
    for level, sep, below in (("s", "[|]", "^[^:]*:"), ("p", ",", "^[^.]*[.]"), ("l", "[.]", None)):
        d = d.withColumns({"__u": F.split("__x", sep, -1), "__v": F.split("__y", sep, -1)})
        d = d.withColumn(f"__{level}", F.array_position(F.zip_with("__u", "__v", lambda x, y: ~node(x).eqNullSafe(node(y))), True) - 1)
        if below:
            part = lambda c: F.regexp_replace(F.coalesce(F.get(c, F.col(f"__{level}").cast("int")), F.lit("")), below, "")  # noqa: E731, B023
            d = d.withColumns({"__x": part("__u"), "__y": part("__v")})
    return d.select(*whole, F.when(F.col(a) != F.col(b), F.concat_ws(".", *[F.greatest(F.col(f"__{x}"), F.lit(0)) for x in "spl"])).alias(name))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_edit of every row of docs
    (doc_id, text); null texts are empty.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row in
    ascending (doc_id, text checksum) order; after the last comes the first, so a single row is its own next.
    Rows are dealt into ranges of that order, so one id with many different texts is spread; each range also gets the
    first row of the next one, so one shuffle of the texts is enough and no range needs another. The ranges' first keys are a
    small table (a row a range, 4096 at most); none reaches the driver or the plan.
    A null id sorts first; repeated rows follow one another; an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    parts = common.partitions(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("crc", F.crc32("text"))
    n = int(min(4096, max(4 * parts, docs.count() // 2000)))
    base = common.with_ranges(base, ["doc_id", "crc"], n)
    heads = base.groupBy("bin").agg(F.min(F.struct("doc_id", "crc")).alias("h"))
    order = Window.orderBy("bin")  # a row for each range
    into = heads.select(F.coalesce(F.lag("bin").over(order), F.max("bin").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"), F.col("h.doc_id").alias("h_id"), F.col("h.crc").alias("h_crc"))
    into = common.saved(into, "heads")
    guard = base.join(F.broadcast(into), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("crc") == F.col("h_crc")))
    guard = guard.groupBy("to").agg(F.min(F.struct("doc_id", "crc", "text")).alias("r")).select("r.doc_id", "r.text", "r.crc", F.col("to").alias("bin"), F.lit(1).alias("last"))
    rows = base.withColumn("last", F.lit(0)).unionByName(guard).repartition(max(parts, 1), "bin")
    own = rows.withColumn("nodes", tree(F.col("text"))).withColumn("leaves", leaf_set(F.col("nodes"))).withColumn("fingerprint", fingerprint(F.col("nodes"))).drop("nodes")
    w = Window.partitionBy("bin").orderBy("last", "doc_id", "crc")
    both = own.select("*", F.lead("text").over(w).alias("next_text"), F.lead("leaves").over(w).alias("next_leaves")).where("last = 0")
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    both = both.withColumn("n_chars", chars.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = both.select("doc_id", "n_chars", "edited", "leaves", "fingerprint", "next_leaves", tree(F.col("edited")).alias("nodes"))
    both = both.withColumn("edited_leaves", leaf_set(F.col("nodes"))).withColumn("edited_fingerprint", fingerprint(F.col("nodes")))
    out = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"))
    return with_first_edit(out, "fingerprint", "edited_fingerprint")
