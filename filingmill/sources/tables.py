"""Stored tables with a unique key, merged by partition.

A keyed table is Parquet files partitioned by a function of the key: by default a hash into ``parts`` partitions (the folders
are called ``key_part_<parts>=<n>``, so the number is read back from them), or a column such as the month of a date in the
key, which keeps a daily batch to the partitions of its days. A merge finds the partitions its rows fall into, reads and
rewrites only those (the rest is neither listed into the job nor touched), and replaces them by dynamic partition overwrite,
which moves finished files once all tasks have ended: lost executors are run again and readers see whole partitions.

Defined results: of several new rows of a key the one with the greatest ``order`` stays, among equals the greatest row; null
keys are keys like others; merging an empty table changes nothing; columns that only one side has are null on the other;
merging again with the same rows gives the same table, so a driver that dies during the last moves starts the merge again
from its source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete, subfolders

#: Partitions of a new table by hash: choose so that one holds about a gigabyte.
PARTS = 64
_HASHED = "key_part_"
#: Tasks that a partition is dealt over at most, so files that a merge makes of it.
SHARES = 16
_SHARE = "__share"


def last_of_key(new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``, without that column. Combined before it is shuffled, so a key with
    any number of rows is one row by then."""
    rest = [c for c in new.columns if c not in (*key, order)]
    row = F.struct(*[F.col(f"`{c}`") for c in (order, *rest)])
    maps = any("map<" in kind for c, kind in new.dtypes if c in rest)  # these have no order; their text has
    last = F.max_by(row, F.struct(order, F.to_json(row))) if maps else F.max(row)
    return new.groupBy(*key).agg(last.alias("__row")).select(*key, *[F.col("__row")[c].alias(c) for c in rest])


@dataclass(frozen=True)
class KeyedTable:
    """A table in the folder ``path`` with a unique ``key``. ``by`` names the column of the rows to partition by, a function of
    the key. Without it rows are hashed by ``spread`` (columns of the key; all of it if not given)."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    by: str | None = None
    spread: tuple[str, ...] = ()
    parts: int = PARTS

    def _stored_column(self) -> str | None:
        """Name of the partition column on disk, or None before the first write."""
        names = {name.split("=")[0] for name in subfolders(self.spark, self.path) if "=" in name}
        return next(iter(names), None)

    def _placed(self, rows: DataFrame) -> tuple[DataFrame, str]:
        if self.by:  # as marked text, so that no value is read back as another type
            return rows.withColumn(f"by_{self.by}", F.coalesce(F.concat(F.lit("v"), F.col(self.by).cast("string")), F.lit("none"))), f"by_{self.by}"
        column = self._stored_column() or f"{_HASHED}{self.parts}"
        parts = int(column.removeprefix(_HASHED))
        return rows.withColumn(column, F.pmod(F.xxhash64(*(self.spread or self.key)), F.lit(parts)).cast("int")), column

    def _files(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().drop(self._stored_column())

    def _within(self, column: str, parts: list) -> DataFrame | None:
        """The stored rows of some partitions, or None before the first write; other partitions are not opened."""
        return self._files().where(F.col(column).isin(parts)) if parts and self._stored_column() else None

    def _dealt(self, rows: DataFrame, column: str, by: tuple[str, ...]) -> DataFrame:
        """Rows dealt by partition and a share of it: the one exchange that finding the last row of a key, leaving out the rows
        replaced and writing a partition's files need. AQE joins small shares."""
        return rows.withColumn(_SHARE, F.pmod(F.xxhash64(*by), F.lit(SHARES)).cast("int")).repartition(column, _SHARE)

    def _overwrite(self, rows: DataFrame, column: str) -> None:
        rows.drop(_SHARE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(self.path)

    def touched(self, rows: DataFrame) -> list:
        """Partitions that ``rows`` fall into: at most as many as the table has, or dates in it."""
        placed, column = self._placed(rows)
        return sorted(r[0] for r in placed.select(column).distinct().collect())

    def upsert(self, new: DataFrame, order: str) -> list:
        """Puts the last row of each key of ``new`` in place of the stored one; the partitions that were rewritten."""
        placed, column = self._placed(new)
        rows = last_of_key(self._dealt(placed, column, self.key), list(dict.fromkeys([*self.key, column, _SHARE])), order)
        parts = self.touched(new)
        old = self._within(column, parts)
        if not parts:
            return parts
        if old is not None:
            rows = _without(self._dealt(old, column, self.key), rows, self.key, (column, _SHARE)).unionByName(rows, allowMissingColumns=True)
        self._overwrite(rows, column)
        return parts

    def replace(self, owners: DataFrame, new: DataFrame) -> list:
        """Takes out all rows of ``owners`` (columns of the partition's function, such as filing_id) and puts in ``new``, rows of
        those owners: also where an owner has none. A partition that ends empty is deleted."""
        mine = list(owners.columns)
        gone, column = self._placed(owners.distinct())
        rows = self._dealt(self._placed(new)[0], column, tuple(mine))
        parts = self.touched(gone.drop(*([column] if column not in mine else [])))
        old = self._within(column, parts)
        if old is not None:
            rows = _without(self._dealt(old, column, tuple(mine)), self._dealt(gone, column, tuple(mine)), tuple(mine), (column, _SHARE)).unionByName(rows, allowMissingColumns=True)
        left = {r[0] for r in rows.select(column).distinct().collect()}  # at most the partitions of the table
        if left:
            self._overwrite(rows, column)
        emptied = {f"{column}={p}" for p in set(parts) - left}
        for folder in subfolders(self.spark, self.path) if emptied else ():
            if unquote(folder) in emptied:
                delete(self.spark, f"{self.path}/{folder}")
        return parts


def _without(old: DataFrame, new: DataFrame, key: tuple[str, ...], dealt: tuple[str, ...]) -> DataFrame:
    """Stored rows whose key is not among the new ones; null keys are equal. Both sides are dealt by columns that are never null,
    whose plain equality lets the join take the rows where they are."""
    key = tuple(c for c in key if c not in dealt)
    keys = new.select(*[F.col(c).alias(f"__new_{c}") for c in (*key, *dealt)]).distinct()
    same: list[Column] = [F.col(c).eqNullSafe(F.col(f"__new_{c}")) for c in key] + [F.col(c) == F.col(f"__new_{c}") for c in dealt]
    return old.join(keys, reduce(lambda a, b: a & b, same), "left_anti")
