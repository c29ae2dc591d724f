"""A revision journal: links, breaks, head, undo, next revision, torn tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _book():
    return Window.partitionBy("book").orderBy("line_no")


def links(receipts: DataFrame) -> DataFrame:
    """Each receipt with `linked`: its base is the hash before it and its revision grows; the first is."""
    before = F.lag("result_hash").over(_book())
    ok = (F.col("base_hash") == before) & (F.col("rev") > F.lag("rev").over(_book()))
    return receipts.withColumn("expected", before).withColumn("linked", F.row_number().over(_book()).eqNullSafe(F.lit(1)) | F.coalesce(ok, F.lit(False)))


def breaks(receipts: DataFrame) -> DataFrame:
    return links(receipts).filter("not linked").select("book", "line_no", "expected", F.col("base_hash").alias("found"))


def head(receipts: DataFrame) -> DataFrame:
    """Each book's last receipt, as one aggregate."""
    last = receipts.groupBy("book").agg(F.max_by(F.struct(*receipts.columns), "line_no").alias("r"))
    return last.select("r.*")


def undo_target(receipts: DataFrame) -> DataFrame:
    """Each book's last revision whose result is what its head was based on."""
    top = head(receipts).select("book", F.col("base_hash").alias("wanted"), F.col("line_no").alias("head_line"))
    past = receipts.join(top, "book").filter("line_no < head_line and result_hash = wanted")
    return past.groupBy("book").agg(F.max_by("rev", "line_no").alias("rev"))


def next_revision(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """One more than the largest revision among receipts and revision files."""
    both = receipts.select("book", "rev").unionByName(files.select("book", "rev"))
    return both.groupBy("book").agg((F.max("rev") + 1).alias("next_rev"))


def status(receipts: DataFrame, current: DataFrame) -> DataFrame:
    """Per book of `current` (book, hash): genesis, ok or external_edit."""
    top = head(receipts).select("book", "result_hash")
    state = F.when(F.col("result_hash").isNull(), "genesis").when(F.col("result_hash") == F.col("hash"), "ok").otherwise("external_edit")
    return current.join(top, "book", "left").select("book", state.alias("status"))
