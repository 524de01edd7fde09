"""Numbered commits that name the data of all tables of a store.

A commit is one small file, created once under its number after all data that it names is
complete. Data folders are never written again. Whoever reads takes the commit of the
highest number and sees the tables as of that commit, whatever is written meanwhile; what
no commit names does not exist for readers.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from tallywright.sources.files import create_once, names_in, read_small, remove


@dataclass(frozen=True)
class Commit:
    """The folders that make up the tables: one snapshot of the users, and the loads of the others."""

    version: int = 0
    users: str | None = None
    contributions: tuple[str, ...] = ()
    files: tuple[str, ...] = ()


class CommitLog:
    """The commits below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:010d}.json"

    def versions(self) -> list[int]:
        """The numbers of all commits that are kept, in order."""
        names = names_in(self.spark, self.folder)
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, version: int) -> Commit:
        named = json.loads(read_small(self.spark, self._path(version)))
        return Commit(version, named["users"], tuple(named["contributions"]), tuple(named["files"]))

    def latest(self) -> Commit:
        """The last commit; an empty one where there is none."""
        versions = self.versions()
        return self.read(versions[-1]) if versions else Commit()

    def add(self, commit: Commit) -> bool:
        """Publishes a commit; False, and nothing changed, where its number is taken."""
        named = {name: value for name, value in asdict(commit).items() if name != "version"}
        return create_once(self.spark, self._path(commit.version), json.dumps(named))

    def forget(self, versions: list[int]) -> None:
        for version in versions:
            remove(self.spark, self._path(version))
