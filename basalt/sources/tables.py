"""Tables kept as Parquet, one folder for each version, with their changes; and plain readers and writers.

Every operation is a Spark job that writes the next version's rows and the changes beside them.  What a version is
(parent, operation, time) is a row of a Parquet log.  There is one writer at a time.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.changes import CHANGE_TYPE, COMMIT_TIMESTAMP, COMMIT_VERSION
from ..operators.incremental import change_feed

_LOG = "version long, operation string, committed_at timestamp, keys string, app_id string, app_version long"


class ConstraintError(ValueError):
    """Rows break a constraint of the table."""


@dataclass
class VersionedTable:
    """A table at a path, by version; ``keys`` tell rows apart where rows change."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    constraints: tuple[str, ...] = ()
    append_only: bool = False

    def _exists(self, part: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def history(self) -> DataFrame:
        """One row for each version, the last first."""
        if not self._exists("_log"):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/_log").orderBy(F.desc("version"))

    def version(self) -> int:
        """-1 before the first write."""
        row = self.history().agg(F.max("version")).first()
        return -1 if row[0] is None else row[0]

    def read(self, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """The latest version, a given one, or the last before a time."""
        if as_of is not None:
            version = self.history().where(F.col("committed_at") <= F.lit(as_of)).agg(F.max("version")).first()[0]
        version = self.version() if version is None else version
        if version is None or version < 0:
            raise ValueError(f"{self.path} has no such version")
        return self.spark.read.parquet(f"{self.path}/v={version}")

    def check(self, df: DataFrame) -> list[str]:
        """The constraints that rows break; a null result is no violation."""
        if not self.constraints:
            return []
        row = df.agg(*[F.count_if(~F.expr(c)).alias(str(i)) for i, c in enumerate(self.constraints)]).first()
        return [c for i, c in enumerate(self.constraints) if row[i]]

    def _commit(self, df: DataFrame, operation: str, changes: DataFrame | None, app: tuple[str, int] | None = None) -> int:
        if broken := self.check(df):
            raise ConstraintError(f"rows break {broken}")
        version = self.version() + 1
        now = dt.datetime.now(dt.UTC)
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        written = self.spark.read.parquet(f"{self.path}/v={version}")
        if changes is None:
            old = self.read(version - 1) if version else written.limit(0)
            changes = change_feed(old, written, list(self.keys))
        stamped = changes.withColumn(COMMIT_VERSION, F.lit(version).cast("long")).withColumn(COMMIT_TIMESTAMP, F.lit(now))
        stamped.write.mode("overwrite").parquet(f"{self.path}/_changes/c={version}")
        log = self.spark.createDataFrame([(version, operation, now, ",".join(self.keys), *(app or (None, None)))], _LOG)
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/_log")
        return version

    def write(self, df: DataFrame, mode: str = "append", app: tuple[str, int] | None = None) -> int:
        """Appends or overwrites.  A write whose (application, number) is in the log is not done again."""
        if app and not self.history().where((F.col("app_id") == app[0]) & (F.col("app_version") >= app[1])).isEmpty():
            return self.version()
        if mode == "append" and self.version() >= 0:
            return self._commit(self.read().unionByName(df, allowMissingColumns=True), "append", df.withColumn(CHANGE_TYPE, F.lit("insert")), app)
        if mode == "overwrite" and self.append_only and self.version() >= 0:
            raise PermissionError("the table only takes new rows")
        return self._commit(df, mode, None, app)

    def _change(self, df: DataFrame, operation: str) -> int:
        if self.append_only:
            raise PermissionError("the table only takes new rows")
        return self._commit(df, operation, None)

    def delete(self, predicate: str) -> int:
        """Rows for which the predicate is true go; an empty predicate is refused."""
        if not predicate.strip():
            raise ValueError("a delete needs a predicate")
        return self._change(self.read().where(~F.coalesce(F.expr(predicate), F.lit(False))), "delete")

    def update(self, assignments: dict[str, str], predicate: str = "true") -> int:
        hit = F.coalesce(F.expr(predicate), F.lit(False))
        df = self.read()
        return self._change(df.select(*[F.when(hit, F.expr(assignments[c])).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in df.columns]), "update")

    def merge(self, source: DataFrame, updates: dict[str, str] | None = None, inserts: bool = True, matched: str = "true", not_matched: str = "true", delete_unmatched: str | None = None) -> int:
        """Matches by key: updates (expressions over t. and s.; all columns if none are named), inserts, deletes.

        One full join on the keys; a row of the table goes if ``delete_unmatched`` is true for it and the source lacks it.
        """
        df = self.read()
        t = df.select(F.struct(*df.columns).alias("t"), *[F.col(k).alias(f"_t_{k}") for k in self.keys])
        s = source.select(F.struct(*source.columns).alias("s"), *[F.col(k).alias(f"_s_{k}") for k in self.keys])
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & (F.col(f"_t_{k}") == F.col(f"_s_{k}"))
        both = t.join(s, cond, "full")
        here, there = F.col("t").isNotNull(), F.col("s").isNotNull()
        change = updates if updates is not None else {c: f"s.{c}" for c in source.columns if c in df.columns}
        hit = here & there & F.coalesce(F.expr(matched), F.lit(False))
        keep = here | (F.lit(inserts) & F.coalesce(F.expr(not_matched), F.lit(False)))
        if delete_unmatched:
            keep = keep & ~(here & ~there & F.coalesce(F.expr(delete_unmatched), F.lit(False)))
        new = lambda c: F.col(f"s.{c}") if c in source.columns else F.lit(None)
        out = [F.when(~here, new(c)).when(hit, F.expr(change[c]) if c in change else F.col(f"t.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in df.columns]
        return self._change(both.where(keep).select(*out), "merge")

    def restore(self, version: int) -> int:
        return self._change(self.read(version), f"restore {version}")

    def compact(self, files: int) -> int:
        """The same rows in fewer files: a version without changes."""
        now = self.read()
        return self._commit(now.coalesce(files), "compact", now.limit(0).withColumn(CHANGE_TYPE, F.lit("insert")))

    def vacuum(self, keep: int, dry_run: bool = True) -> list[int]:
        """Versions older than the last ``keep``; unless dry, their rows go.  The log and the changes stay."""
        old = [r.version for r in self.history().select("version").collect()][max(1, keep) :]
        if not dry_run:
            for v in old:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return old

    def changes(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Changes of versions from ``start`` to ``end``, both included."""
        last = self.version() if end is None else end
        paths = [f"{self.path}/_changes/c={v}" for v in range(start or 0, last + 1) if self._exists(f"_changes/c={v}")]
        if not paths:
            raise ValueError("no changes in that range")
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def snapshot(self) -> DataFrame:
        """One row: version, rows, files, when and how it was written."""
        v = self.version()
        df = self.read(v)
        counts = df.agg(F.count("*").alias("row_count"))
        files = self.files().agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"))
        log = self.history().where(F.col("version") == v).select("version", "operation", "committed_at", "keys")
        return log.join(counts, F.lit(True)).join(files, F.lit(True))  # one row each

    def files(self) -> DataFrame:
        """One row for each data file of the latest version, with the least and greatest of each key."""
        df = self.read()
        stats = [f(k).alias(f"{n}_{k}") for k in self.keys for n, f in (("min", F.min), ("max", F.max))]
        return df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes")).agg(F.count("*").alias("row_count"), *stats)


class Cursor:
    """How far a consumer has come in a table's changes.

    It moves only when the work on the changes has ended well, so a consumer that fails sees them again.
    """

    def __init__(self, table: VersionedTable, name: str) -> None:
        self.table, self.path = table, f"{table.path}/_cursors/{name}"

    def position(self) -> int:
        if not self.table._exists(self.path.removeprefix(self.table.path + "/")):
            return -1
        return self.table.spark.read.schema("version long").parquet(self.path).agg(F.max("version")).first()[0]

    def process(self, work) -> int | None:
        """Gives the new changes to ``work`` and moves on; None if there are none."""
        done, last = self.position(), self.table.version()
        if last <= done:
            return None
        work(self.table.changes(done + 1, last))
        self.table.spark.createDataFrame([(last,)], "version long").coalesce(1).write.mode("append").parquet(self.path)
        return last
