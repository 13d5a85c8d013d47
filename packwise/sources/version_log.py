"""The inspection store as a log: every change is a new folder of rows, readers see the newest version of each id.

Nothing is rewritten. A write adds a folder under `data` (by month, ordered by owner and date inside it) and then one line to
the manifest; that line alone makes the write visible, so a job that dies halfway leaves nothing behind that anyone reads.
Corrections are rows with a higher version, whatever month they fall into; deletions are tombstone rows. A compaction
writes the current state as a new base and one manifest line that replaces the folders it was made from: a reader sees
the old folders or the new one, never both.

Each commit also keeps by how much it changed the numbers of each day (`changes`), so dashboards add up small tables
instead of reading records, and corrections and deletions count at once.

Of equal versions of an id the later commit wins, within one commit a fixed row. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analytics import SUMS, measure_sums, measures_of
from ..plans.search import visible_to
from .store import MONTH, findable, latest, with_month

MANIFEST = "commit long, folder string, base boolean, replaces array<string>, source string"
COMMIT, GONE, FOLDER = "log__commit", "log__gone", "log__folder"


class VersionLog:
    """schema: columns of the records (DDL), with the key, a version, and `created_at`; `summed`: keep numbers by day, for
    records that have status, violation_count and confidence."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "inspection_id", version: str = "version", summed: bool = False):
        self.spark, self.path, self.key, self.version, self.summed = spark, path.rstrip("/"), key, version, summed
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self.schema = f"{schema}, {COMMIT} long, {GONE} boolean, {MONTH} string"

    # ---------------------------------------------------------------- manifest
    def commits(self) -> list:
        """Manifest lines in order of writing; their number is that of the writes since the log began."""
        try:
            return sorted(self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect(), key=lambda c: (c.commit, c.folder))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def live(self) -> list:
        every = self.commits()
        replaced = {f for c in every for f in c.replaces}
        return [c for c in every if c.folder not in replaced]

    def _publish(self, commit: int, folder: str, base: bool, replaces: list[str], source: str | None) -> None:
        line = self.spark.createDataFrame([(commit, folder, base, replaces, source)], MANIFEST)
        line.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    # ---------------------------------------------------------------- rows
    def _rows(self, commits: list) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        return self._read([c.folder for c in commits])

    def _read(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, {FOLDER} string").option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{FOLDER}={f}" for f in folders]).drop(FOLDER)

    def _newest(self, rows: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(c) for c in rows.columns])
        return rows.groupBy(self.key).agg(F.max_by(row, F.struct(self.version, COMMIT)).alias("r")).select("r.*")

    def _state(self, commits: list, of: DataFrame | None = None) -> DataFrame:
        """The newest row of each id, tombstones included; of: only these ids.

        Ids of the base are unique: only those that later commits touch are compared, all others pass as they are.
        """
        base, later = self._rows([c for c in commits if c.base]), self._rows([c for c in commits if not c.base])
        if of is not None:
            base, later = base.join(of, self.key, "left_semi"), later.join(of, self.key, "left_semi")
        if not any(c.base for c in commits):
            return self._newest(later)
        touched = later.select(self.key)
        compared = self._newest(base.join(touched, self.key, "left_semi").unionByName(later))
        return base.join(touched, self.key, "left_anti").unionByName(compared)

    def snapshot(self) -> DataFrame:
        """The records as they stand, with their month, so that filters on it reach the folders."""
        return self._state(self.live()).where(~F.col(GONE)).select(*self.columns, MONTH)

    def _write(self, rows: DataFrame, folder: str) -> DataFrame:
        dated = with_month(rows.select(*self.columns, COMMIT, GONE)).hint("rebalance", MONTH)
        order = [c for c in ("user_id", "user_no", "created_at") if c in self.columns]
        writer = dated.sortWithinPartitions(MONTH, *order).write.partitionBy(MONTH).options(**findable(self.key))
        writer.parquet(f"{self.path}/data/{FOLDER}={folder}")
        return self._read([folder])

    def lookup(self, ids: list, requester: str | int | None, admin: bool, owners: list[str]) -> DataFrame:
        """The records with these ids that the requester may see, as they stand. The ids reach the scans of all folders, whose
        row groups are skipped by Bloom filter; versions are compared among what is left."""
        rows = self._rows(self.live()).where(F.col(self.key).isin(ids))
        return self._newest(rows).where(~F.col(GONE) & visible_to(requester, admin, owners)).select(*self.columns, MONTH)

    # ---------------------------------------------------------------- changes
    def _numbers(self, rows: DataFrame) -> DataFrame:
        return measure_sums(rows.withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), ["day"])

    def _write_changes(self, before: DataFrame, after: DataFrame, folder: str) -> None:
        less = self._numbers(before).select("day", *[(-F.col(c)).alias(c) for c in SUMS])
        both = self._numbers(after).select("day", *SUMS).unionByName(less)
        both.groupBy("day").agg(*[F.sum(c).cast(t).alias(c) for c, t in SUMS.items()]).write.parquet(f"{self.path}/changes/{folder}")

    def _day_sums(self, commits: list) -> DataFrame:
        schema = "day string, " + ", ".join(f"{c} {t}" for c, t in SUMS.items())
        if not commits:
            return self.spark.createDataFrame([], schema)
        changes = self.spark.read.schema(schema).parquet(*[f"{self.path}/changes/{c.folder}" for c in commits])
        return changes.groupBy("day").agg(*[F.sum(c).cast(t).alias(c) for c, t in SUMS.items()])

    def measures(self, by: list[str] | None = None) -> DataFrame:
        """Dashboard numbers of the current state, by `day` or over all, from the changes alone."""
        return measures_of(self._day_sums(self.live()).where("total > 0"), by)

    # ---------------------------------------------------------------- writes
    def upsert(self, new: DataFrame, source: str | None = None) -> bool:
        """Add versions of records. A source (say, a micro-batch) is taken once; returns whether anything was written."""
        live = self.live()
        if source is not None and any(c.source == source for c in self.commits()):
            return False
        commit, folder = 1 + max((c.commit for c in live), default=0), uuid.uuid4().hex
        rows = latest(new.select(*self.columns), self.key, self.version)
        written = self._write(rows.withColumn(COMMIT, F.lit(commit).cast("long")).withColumn(GONE, F.lit(False)), folder)
        if self.summed:
            before = self._state(live, of=written.select(self.key))
            after = self._newest(before.unionByName(written))
            self._write_changes(before.where(~F.col(GONE)), after.where(~F.col(GONE)), folder)
        self._publish(commit, folder, False, [], source)
        return True

    def delete(self, ids: DataFrame, requester: str | int | None, admin: bool, owners: list[str]) -> int:
        """Tombstones for those of the ids that the requester may delete; returns their number. Without any, nothing is published."""
        live = self.live()
        commit, folder = 1 + max((c.commit for c in live), default=0), uuid.uuid4().hex
        allowed = self._state(live).where(~F.col(GONE)).where(visible_to(requester, admin, owners)).join(ids.select(self.key), self.key, "left_semi")
        gone = allowed.withColumn(COMMIT, F.lit(commit).cast("long")).withColumn(GONE, F.lit(True))
        written = self._write(gone, folder)
        deleted = written.count()  # from the footers of what was written
        if deleted:
            if self.summed:
                self._write_changes(written, written.limit(0), folder)
            self._publish(commit, folder, False, [], None)
        return deleted

    def compact(self) -> None:
        """The current state as a new base; a job of its own, beside which readers go on. Tombstones stay, so that an old
        version of a deleted record that is delivered again stays deleted."""
        live = self.live()
        if len(live) < 2:
            return
        folder = uuid.uuid4().hex
        self._write(self._state(live), folder)
        if self.summed:
            self._day_sums(live).write.parquet(f"{self.path}/changes/{folder}")
        self._publish(max(c.commit for c in live), folder, True, [c.folder for c in live], None)


def of_records(records: DataFrame, path: str, key: str, version: str = "version", summed: bool = False) -> VersionLog:
    """A new log that holds these records."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    log = VersionLog(records.sparkSession, path, schema, key, version, summed)
    log.upsert(records)
    return log
