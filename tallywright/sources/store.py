"""The Parquet tables of contributions and users, and the loads that grow them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.clock import utc_day
from tallywright.functions.collation import collated, spelled
from tallywright.functions.derived import with_contribution_columns
from tallywright.operators.first_wins import first_wins, not_stored
from tallywright.operators.user_dimension import apply_inserted_dates, backfill_dates, upsert_users
from tallywright.schemas import CONTRIBUTIONS, LANDED_FILES, USERS
from tallywright.sources.commit_log import Commit, CommitLog
from tallywright.sources.files import full_path, names_in, remove
from tallywright.sources.landing import (
    LOAD_ORDER,
    PREFIX,
    accepted,
    checked,
    list_files,
    read_files,
    require_clean,
)


class ConcurrentLoadError(RuntimeError):
    """Other writers have committed each time that this one tried to."""


class Snapshot:
    """Both tables, and the landing files they came from, as of one commit."""

    def __init__(self, spark: SparkSession, root: str, commit: Commit, id_collation: str | None = None):
        self.spark = spark
        self.root = root
        self.commit = commit
        self.id_collation = id_collation

    def _loads(self, table: str, loads: Sequence[str], schema: T.StructType) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{load}" for load in loads])
        return rows.select(schema.names)

    def contributions(self) -> DataFrame:
        return collated(self._loads("contributions", self.commit.contributions, CONTRIBUTIONS), self.id_collation, "user_id")

    def landed_files(self) -> DataFrame:
        """Root and key of every landing file that has been loaded."""
        return self._loads("files", self.commit.files, LANDED_FILES)

    def users(self) -> DataFrame:
        if self.commit.users is None:
            users = self.spark.createDataFrame([], USERS)
        else:
            users = self.spark.read.schema(USERS).parquet(f"{self.root}/users/{self.commit.users}")
        return collated(users, self.id_collation, "id")


class ContributionStore:
    """Contributions by UTC day, versioned snapshots of users and a log of commits below one folder.

    A load writes its contributions, the names of its files and the next users snapshot into
    folders of their own, then publishes all of them with one commit. Until then readers see
    the state before, and a load that dies leaves nothing behind but folders that no commit
    names (`remove_old_snapshots` deletes them): running it again is all there is to do.

    Of two writers that began at the same commit one publishes first; the other throws its
    folders away and does its work again on the new state, up to `attempts` times.

    With `id_collation` (see `functions.collation`) user ids that differ only in what the
    collation ignores are one user, in loads and in reports; users keep their first spelling.
    All loads of a store must use the same one.
    """

    def __init__(self, spark: SparkSession, root: str, *, attempts: int = 5, id_collation: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.attempts = attempts
        self.id_collation = id_collation
        self.log = CommitLog(spark, f"{self.root}/log")

    # Reading

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The tables as of the last commit, or of an older one that is still kept."""
        commit = self.log.latest() if version is None else self.log.read(version)
        return Snapshot(self.spark, self.root, commit, self.id_collation)

    def contributions(self) -> DataFrame:
        return self.snapshot().contributions()

    def users(self) -> DataFrame:
        return self.snapshot().users()

    # Loading

    def load_landing(self, landing_root: str, prefix: str = PREFIX, *, multi_line: bool = False) -> None:
        """Imports every matching file below `landing_root`."""
        self.load_files(list_files(self.spark, landing_root, prefix), multi_line=multi_line, landing_root=landing_root)

    def load_new(self, landing_root: str, prefix: str = PREFIX, *, multi_line: bool = False) -> None:
        """Imports the matching files that no earlier load of this store has taken, however old they are.

        Files are known by root and key. The names of a load are committed with its rows, so a
        file is either loaded and known or neither. Known names are a table: the comparison is a join.
        """
        listed = list_files(self.spark, landing_root, prefix)
        known = self.snapshot().landed_files().filter(F.col("landing_root") == full_path(self.spark, landing_root))
        self.load_files(listed.join(known, "key", "left_anti"), multi_line=multi_line, landing_root=landing_root)

    def load_files(self, files: DataFrame, *, multi_line: bool = False, landing_root: str | None = None) -> None:
        """Imports the files of an inventory, all or none of them; with `landing_root` they count as loaded from there.

        Files are read for their headers and once more for their rows, which are checked and
        staged below the store; all further steps read the staged rows.
        """
        listed = files.collect()
        if not listed:
            return
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        try:
            checked(read_files(self.spark, listed, multi_line=multi_line)).write.parquet(staging)
            rows = self.spark.read.parquet(staging)
            require_clean(rows)
            days = {f["file_ts"].date() for f in listed}
            names = None
            if landing_root is not None:
                root = full_path(self.spark, landing_root)
                names = self.spark.createDataFrame([(root, f["key"], f["file_ts"].date()) for f in listed], LANDED_FILES)
            self._load(accepted(rows), LOAD_ORDER, days, names)
        finally:
            remove(self.spark, staging)

    def load_rows(self, rows: DataFrame, order: Sequence[Column | str]) -> None:
        """Adds contribution rows; per user and UTC day the first in `order` wins, stored rows before all.

        Historic rows come in this way, with any order columns. Rows without a
        time have no day to share, so all of them are kept.
        """
        days = {row[0] for row in rows.select(utc_day("timestamp")).distinct().collect()}
        self._load(rows, order, days)

    def _load(
        self, rows: DataFrame, order: Sequence[Column | str], days: set[date | None], names: DataFrame | None = None
    ) -> None:
        rows = collated(with_contribution_columns(rows), self.id_collation, "user_id")

        def write(base: Snapshot) -> Commit:
            # `days` has one entry per calendar day of the load; only those
            # partitions of the stored table are compared with.
            stored = base.contributions().filter(F.col("contrib_date").isin([d for d in days if d is not None]))
            winners = first_wins(rows.filter("contrib_date IS NOT NULL"), order)
            fresh = not_stored(winners, stored)
            if None in days:
                fresh = fresh.unionByName(rows.filter("contrib_date IS NULL"))
            now = F.current_timestamp()
            filled = {"contributions_created": now, "contributions_modified": now, "user_id": spelled("user_id")}
            load = _new_name("load=")
            write_by_day(
                fresh.select(*[filled.get(name, F.col(name)).alias(name) for name in CONTRIBUTIONS.names]),
                f"{self.root}/contributions/{load}",
            )
            commit = base.commit
            if _holds_rows(self.spark, f"{self.root}/contributions/{load}"):
                commit = replace(commit, contributions=(*commit.contributions, load))
            if names is not None:
                known = base.landed_files().join(F.broadcast(names), ["landing_root", "key"], "left_semi")
                names.join(known, ["landing_root", "key"], "left_anti").write.parquet(f"{self.root}/files/{load}")
                commit = replace(commit, files=(*commit.files, load))
            inserted = Snapshot(self.spark, self.root, Commit(contributions=(load,)), self.id_collation).contributions()
            return self._with_users(commit, apply_inserted_dates(upsert_users(rows, base.users(), order), inserted))

        self._commit(write)

    def backfill_users(self) -> None:
        """Recomputes the dates of all users from the stored contributions."""
        self._commit(lambda base: self._with_users(base.commit, backfill_dates(base.users(), base.contributions())))

    def compact(self) -> None:
        """Rewrites all loads of each table as one, so that commits stay short and days have few files."""

        def write(base: Snapshot) -> Commit:
            load = _new_name("load=")
            commit = base.commit
            if commit.contributions:
                write_by_day(base.contributions().withColumn("user_id", spelled("user_id")), f"{self.root}/contributions/{load}")
                commit = replace(commit, contributions=(load,))
            if commit.files:
                base.landed_files().repartitionByRange("landing_day", "key").write.parquet(f"{self.root}/files/{load}")
                commit = replace(commit, files=(load,))
            return commit

        self._commit(write)

    # Committing

    def _with_users(self, commit: Commit, users: DataFrame) -> Commit:
        # A new folder each time: the snapshot being read is never overwritten.
        name = _new_name("snapshot_")
        users.withColumn("id", spelled("id")).write.parquet(f"{self.root}/users/{name}")
        return replace(commit, users=name)

    def _commit(self, write: Callable[[Snapshot], Commit]) -> None:
        """Publishes what `write` makes of the current state; where another writer was first, makes it anew of the new one."""
        for _ in range(self.attempts):
            base = self.snapshot()
            commit = replace(write(base), version=base.commit.version + 1)
            if self.log.add(commit):
                return
            for folder in sorted(set(_folders(commit)) - set(_folders(base.commit))):
                remove(self.spark, f"{self.root}/{folder}")
        raise ConcurrentLoadError(f"others have committed during {self.attempts} attempts; run this load again")

    def remove_old_snapshots(self, keep: int = 2) -> None:
        """Forgets all commits but the last `keep`, and removes what no kept one names, leftovers of loads that died too.

        Not while a load runs, nor while older views of the tables are in use.
        """
        versions = self.log.versions()
        kept = versions[-max(1, keep) :]
        named = {folder for version in kept for folder in _folders(self.log.read(version))}
        self.log.forget([version for version in versions if version not in kept])
        for table, start in (("users", "snapshot_"), ("contributions", "load="), ("files", "load=")):
            for name in names_in(self.spark, f"{self.root}/{table}"):
                if name.startswith(start) and f"{table}/{name}" not in named:
                    remove(self.spark, f"{self.root}/{table}/{name}")
        remove(self.spark, f"{self.root}/staging")


def _new_name(start: str) -> str:
    return f"{start}{uuid.uuid4().hex}"


def _folders(commit: Commit) -> list[str]:
    """Every data folder that a commit names, below the root."""
    users = [f"users/{commit.users}"] if commit.users else []
    return users + [f"contributions/{load}" for load in commit.contributions] + [f"files/{load}" for load in commit.files]


def _holds_rows(spark: SparkSession, folder: str) -> bool:
    return any(name.startswith("contrib_date=") for name in names_in(spark, folder))


def write_by_day(contributions: DataFrame, path: str) -> None:
    """Writes Parquet files partitioned by UTC day.

    Rebalancing gives each day its own files but splits a day too large for one
    task, so a load of a single day is still written in parallel.
    """
    contributions.hint("rebalance", "contrib_date").write.partitionBy("contrib_date").parquet(path)
