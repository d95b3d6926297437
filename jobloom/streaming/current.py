"""Current and superseded versions of records, kept up by a stream: change folders beside a base.

A batch appends its own rows as one folder of changes and touches nothing else. Readers take a base, as the last fold left it,
together with the changes that it doesn't hold yet; only folders whose write was completed count. `compact` folds the changes
into the next base, `vacuum` removes what no reader needs any more. A version is known by a hash of its key and order, so
rows that come again, by a repeated batch or a stream that starts over without its checkpoint, count once.

The base holds the current rows in buckets by key and the history in buckets by version, one folder for each fold: reading
and folding move the changes to the buckets, not the base.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import buckets
from ..sources.folders import delete, exists, listed, read_lines, write_lines

ID = "version_id"
DONE = "_DONE"


@dataclass(frozen=True)
class VersionTable:
    """root: a folder on shared storage. schema: the columns of the records as DDL. order: the columns that sort the versions
    of a key, the last of them unique; nulls come first. Records without a key go. Of rows equal in key and order one is kept."""

    root: str
    schema: str
    key: str
    order: tuple[str, ...]
    buckets: int = buckets.BUCKETS

    # Writing.

    def add(self, batch: DataFrame, number: int) -> None:
        """A batch function: the batch's rows as a change folder. What is written follows the batch alone, and a batch that
        has been written is not written again."""
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        path = f"{self.root}/changes/b={query}-{number:012d}"
        if not exists(spark, f"{path}/_SUCCESS"):
            self._known(batch).write.mode("overwrite").parquet(path)

    def compact(self, spark: SparkSession) -> int:
        """Fold all completed changes into the next base; its number, or the last one's if there are none. One at a time."""
        number, changes, folded = self._state(spark)
        if not changes:
            return number
        new, rows = self._changes(spark, changes), self._schema()
        base, past = self._base(spark, number), self._past(spark, number)
        target = f"{self.root}/base/v={number + 1:08d}"
        for left in (target, f"{self.root}/history/fold={number + 1}"):  # of a fold that was cut off
            delete(spark, left)
        buckets.append(self._current(new, base), target, rows, self.key, self.buckets)
        added = self._superseded(new, base, past).withColumn("fold", F.lit(number + 1).cast("long"))
        buckets.append(added, f"{self.root}/history", rows + ", fold long", ID, self.buckets, "fold")
        write_lines(spark, f"{target}/{DONE}", [*folded, *changes])
        return number + 1

    def vacuum(self, spark: SparkSession, keep: int = 1) -> None:
        """Remove bases older than the last `keep` ones before the newest, and the changes that these hold already."""
        number = self._state(spark)[0]
        oldest = number - keep
        for name in listed(spark, f"{self.root}/base"):
            if int(name.removeprefix("v=")) < oldest:
                delete(spark, f"{self.root}/base/{name}")
        if oldest >= 0:
            for name in read_lines(spark, f"{self.root}/base/v={oldest:08d}/{DONE}"):
                delete(spark, f"{self.root}/changes/{name}")

    # Reading.

    def current(self, spark: SparkSession) -> DataFrame:
        """The latest version of each key."""
        number, changes, _ = self._state(spark)
        base = self._base(spark, number)
        out = self._current(self._changes(spark, changes), base) if changes else base
        return out.drop(ID)

    def history(self, spark: SparkSession) -> DataFrame:
        """The superseded versions, each once."""
        number, changes, _ = self._state(spark)
        past = self._past(spark, number)
        out = past.unionByName(self._superseded(self._changes(spark, changes), self._base(spark, number), past)) if changes else past
        return out.drop(ID)

    # How both are made.

    def _schema(self) -> str:
        return f"{self.schema}, {ID} string"

    def _known(self, rows: DataFrame) -> DataFrame:
        cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (self.key, *self.order)]
        return rows.where(F.col(self.key).isNotNull()).withColumn(ID, F.sha2(F.concat_ws("\0", *cells), 256))

    def _state(self, spark: SparkSession) -> tuple[int, list[str], list[str]]:
        """(number of the newest complete base, -1 for none; completed change folders that it doesn't hold; those that it
        holds and that still stand). Names only, a few for each batch since the last vacuum."""
        bases = [int(n.removeprefix("v=")) for n in listed(spark, f"{self.root}/base") if exists(spark, f"{self.root}/base/{n}/{DONE}")]
        number = max(bases, default=-1)
        held = set(read_lines(spark, f"{self.root}/base/v={number:08d}/{DONE}")) if bases else set()
        names = listed(spark, f"{self.root}/changes")
        return number, [n for n in names if n not in held and exists(spark, f"{self.root}/changes/{n}/_SUCCESS")], [n for n in names if n in held]

    def _changes(self, spark: SparkSession, names: list[str]) -> DataFrame:
        return spark.read.schema(self._schema()).parquet(*[f"{self.root}/changes/{n}" for n in names])

    def _base(self, spark: SparkSession, number: int) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], self._schema())
        return buckets.read(spark, f"{self.root}/base/v={number:08d}", self._schema(), self.key, self.buckets)

    def _past(self, spark: SparkSession, number: int) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], self._schema())
        every = buckets.read(spark, f"{self.root}/history", self._schema() + ", fold long", ID, self.buckets, "fold")
        return every.where(F.col("fold") <= number).drop("fold")  # a fold that was cut off has a higher number

    def _rank(self, row: Callable[[str], Column]) -> Column:
        return F.struct(*[row(c).alias(c) for c in (*self.order, ID)])

    def _newest(self, new: DataFrame) -> DataFrame:
        """key and the newest changed row `n` of each, reduced before the shuffle and then dealt like the base, which stays."""
        rest = [c for c in new.columns if c != self.key]
        return new.groupBy(self.key).agg(F.max_by(F.struct(*rest), self._rank(F.col)).alias("n")).repartition(self.buckets, self.key)

    def _beside(self, new: DataFrame, base: DataFrame, how: str) -> DataFrame:
        """key, the newest changed row `n`, the base's row `b`, and whether the base's row stays the latest."""
        rest = [c for c in base.columns if c != self.key]
        both = self._newest(new).join(base.select(self.key, F.struct(*rest).alias("b")), self.key, how)
        older = self._rank(lambda c: F.col(f"n.{c}")) <= self._rank(lambda c: F.col(f"b.{c}"))
        return both.withColumn("stays", F.when(F.col("b").isNull(), F.lit(False)).when(F.col("n").isNull(), F.lit(True)).otherwise(older))

    def _current(self, new: DataFrame, base: DataFrame) -> DataFrame:
        last = F.when(F.col("stays"), F.col("b")).otherwise(F.col("n"))
        return self._beside(new, base, "full").withColumn("r", last).select(*[self.key if c == self.key else f"r.{c}" for c in base.columns])

    def _superseded(self, new: DataFrame, base: DataFrame, past: DataFrame) -> DataFrame:
        """The rows that the changes add to the past: changed rows that aren't the latest, and base rows that no longer are."""
        beside = self._beside(new, base, "left")
        latest = beside.select(self.key, F.when(F.col("stays"), F.col(f"b.{ID}")).otherwise(F.col(f"n.{ID}")).alias("__latest"), F.col(f"b.{ID}").alias("__base"))
        fresh = new.repartition(self.buckets, ID).dropDuplicates([ID]).join(past.select(ID), ID, "left_anti")
        older = fresh.join(latest, self.key).where(f"{ID} <> __latest and not {ID} <=> __base")
        left = beside.where("b is not null and not stays").where(f"b.{ID} <> n.{ID}")
        return older.select(*base.columns).unionByName(left.select(*[self.key if c == self.key else f"b.{c}" for c in base.columns]))
