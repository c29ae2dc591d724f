"""Revisions of a frame: immutable snapshots and a journal of receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators import journal
from cellgrid.operators.graph import frozen

RECEIPTS = "book string, line_no long, rev long, kind string, base_hash string, result_hash string, actor string"


class Revisions:
    """`root`/<book>/rev=N holds revision N, written once; `root`/receipts says what led to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def receipts(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/receipts")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], RECEIPTS)
        return self.spark.read.schema(RECEIPTS).parquet(f"{self.root}/receipts")

    def commit(self, book: str, frame: DataFrame, kind: str = "apply", actor: str = "", base_hash: str | None = None) -> int:
        """Writes the next revision, then its receipt. With `base_hash`, refuses unless the head is at it."""
        mine = self.receipts().filter(F.col("book") == book)
        head = journal.head(mine).first()
        now = head.result_hash if head else ""
        if base_hash is not None and base_hash != now:
            raise ValueError(f"{book} is at {now!r}, not {base_hash!r}")
        rev, line = (head.rev + 1, head.line_no + 1) if head else (1, 1)
        frame.write.mode("errorifexists").parquet(f"{self.root}/{book}/rev={rev}")
        written = self.read(book, rev)
        digest = "-".join(str(x) for x in frozen(written).first())
        self.spark.createDataFrame([(book, line, rev, kind, now, digest, actor)], RECEIPTS).coalesce(1).write.mode("append").parquet(f"{self.root}/receipts")
        return rev

    def read(self, book: str, rev: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{book}/rev={rev}")

    def undo(self, book: str) -> int:
        """Commits the revision before the head again."""
        target = journal.undo_target(self.receipts().filter(F.col("book") == book)).first()
        if target is None:
            raise ValueError(f"nothing to undo in {book}")
        return self.commit(book, self.read(book, target.rev), kind="undo")
