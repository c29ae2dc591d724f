"""Canonical exact digests of documents, with DataFrame and SQL functions only.

A text is composed by Unicode's compatibility normalisation, case-folded, composed again, its white
space folded to single spaces and trimmed; the digest is two 64-bit xxhash values under different seeds. Two texts
are alike (1.0) if their digests are equal and so are their canonical bytes, else not (0.0).

A null text is the empty one. Rows with equal doc_id follow each other by text; a null doc_id comes
first. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.cluster import written

#: Ranges of doc_id for each shuffle partition; their bounds and first ids are all that the driver sees.
RANGES_PER_PARTITION = 4
_LEAST = -(2**63)


def canonical(text: Column) -> Column:
    compose = lambda t: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"[\s\u0085\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits of a canonical text."""
    high, low = F.xxhash64(canon), F.xxhash64(F.lit("second seed"), canon)
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (high, low)))


def _ranged(docs: DataFrame) -> DataFrame:
    """`docs` with the range that a row's key falls in, and again in the range before if it is first in its own.

    So each range's last row finds the next one at its side, and ranges are sorted apart from each
    other. The first row of all comes again after the last one (again = 2).
    """
    spark = docs.sparkSession
    ranges = max(2, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("key", shares, 10 * ranges).alias("bounds")).first().bounds or []
    bounds = sorted(set(found))
    if bounds:
        held = F.array(*map(F.lit, bounds))
        steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
        fits = lambda at: (at <= len(bounds)) & (F.try_element_at(held, F.when(at <= len(bounds), at).otherwise(1)) <= F.col("key"))
        own = F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))
    else:
        own = F.lit(0)
    docs = docs.withColumn("range", own)
    first = {r["range"]: r["least"] for r in docs.groupBy("range").agg(F.min("key").alias("least")).collect()}
    order = sorted(first)
    if not order:
        return docs.withColumn("again", F.lit(0))
    before = {r: (order[i - 1], 1 if i else 2) for i, r in enumerate(order)}
    spots = range(order[-1] + 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("range") + 1)
    is_first = F.col("key") == pick([first.get(r, _LEAST) for r in spots])
    here = F.struct(F.col("range"), F.lit(0).alias("again"))
    there = F.struct(
        pick([before.get(r, (0, 1))[0] for r in spots]).alias("range"), pick([before.get(r, (0, 1))[1] for r in spots]).alias("again")
    )
    return (
        docs.withColumn("spot", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
        .withColumn("range", F.col("spot.range"))
        .withColumn("again", F.col("spot.again"))
        .drop("spot")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text) its digest, that of its edited text, and its likeness to that and to the next text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("range").orderBy("again", "key", "text")
    rows = (
        _ranged(rows)
        .withColumn("fingerprint", digest(canonical(F.col("text"))))
        .withColumn("next", F.lead("text").over(order))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .filter("again = 0")
    )
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n.cast("int") - half), F.substring("next", F.lit(1), half))
    )
    rows = rows.withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))

    def alike(other: str, text: str) -> Column:
        same = (F.col("fingerprint") == F.col(other)) & (canonical(F.col("text")) == canonical(F.col(text)))
        return F.when(same, 1.0).otherwise(0.0)

    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        alike("edited_fingerprint", "edited").alias("near_edited"),
        alike("next_fingerprint", "next").alias("near_next"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """The rows of `fingerprints`, and group_id: the smallest doc_id (null: none) whose canonical text has the same bytes.

    Digests meet first, as counts and smallest ids; only rows whose digest repeats are then compared
    with the bytes of their bucket's first text. A bucket with different bytes keeps them apart by
    grouping on the bytes themselves.
    """
    prints = written(fingerprints(docs), "fingerprints")
    buckets = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "buckets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text").cast("string")).alias("canon"))
    rows = rows.withColumn("fingerprint", digest(F.col("canon")))
    bucketed = rows.join(buckets.filter("n > 1"), "fingerprint")
    first = bucketed.filter("doc_id <=> first_id").groupBy("fingerprint").agg(F.min("canon").alias("first_canon"))
    apart = written(bucketed.join(first, "fingerprint").filter("canon <> first_canon").select("doc_id", "fingerprint", "canon"), "collisions")
    others = apart.join(apart.groupBy("canon").agg(F.min("doc_id").alias("other_id")), "canon").select("doc_id", "fingerprint", "other_id").distinct()
    same_row = prints.doc_id.eqNullSafe(others.doc_id) & (prints.fingerprint == others.fingerprint)
    found = prints.join(others, same_row, "left").select(*(prints[c] for c in prints.columns), "other_id", others.fingerprint.isNotNull().alias("apart"))
    group = F.when(F.col("apart"), F.col("other_id")).otherwise(F.col("first_id"))
    return found.join(buckets.select("fingerprint", "first_id"), "fingerprint").select(*prints.columns, group.alias("group_id"))
