"""Versions of several tables that change together: published in two phases, so that a run that dies is completed or undone.

    <root>/versions/<version>/<table>    a version's data
    <root>/current/<table>.json          which version a reader of the table gets
    <root>/intent.json                   what a publication under way means to do

The intent is written before anything else. While it says "copying", the version isn't whole, and recovery removes it;
once it says "ready", with the number of rows of every table, recovery goes on to switch the readers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .store import Folder


class Versions:
    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...]):
        self.spark, self.root, self.tables = spark, Folder(spark, root), tables
        self.intent = self.root / "intent.json"

    def folder(self, version: str, table: str) -> Folder:
        return self.root / "versions" / version / table

    def current(self, table: str) -> str | None:
        text = (self.root / "current" / f"{table}.json").read_text()
        return json.loads(text)["version"] if text else None

    def read(self, table: str) -> DataFrame:
        version = self.current(table)
        if version is None:
            raise ValueError(f"{table} has no version")
        return self.spark.read.parquet(str(self.folder(version, table)))

    def known(self) -> list[str]:
        return (self.root / "versions").names()

    def _point(self, table: str, version: str | None) -> None:
        pointer = self.root / "current" / f"{table}.json"
        if version is None:
            pointer.delete()
        else:
            pointer.write_text(json.dumps({"version": version}))

    def _plan(self, version: str, step: str, **more) -> dict:
        plan = {"version": version, "step": step, "before": {t: self.current(t) for t in self.tables}} | more
        self.intent.write_text(json.dumps(plan))
        return plan

    def publishing(self, version: str, frames: dict[str, DataFrame]) -> Iterator[str]:
        """Publishes step by step; yields the name of each finished step. Stopping in between is what recovery is for."""
        if self.intent.exists():
            raise RuntimeError("another publication is under way or died: recover first")
        if version in self.known():
            raise ValueError(f"version {version} is there already")
        self._plan(version, "copying")
        yield "intent"
        rows = {}
        for t in self.tables:
            frames[t].write.parquet(str(self.folder(version, t)))
            rows[t] = self.spark.read.parquet(str(self.folder(version, t))).count()
            yield f"copied {t}"
        yield from self._switch(self._plan(version, "ready", rows=rows))

    def _switch(self, plan: dict) -> Iterator[str]:
        yield "ready"
        for t in self.tables:
            self._point(t, plan["version"])
            yield f"switched {t}"
        self.intent.delete()
        yield "done"

    def publish(self, version: str, frames: dict[str, DataFrame]) -> None:
        for _ in self.publishing(version, frames):
            pass

    def recover(self) -> str:
        """"consistent", or what was done about a publication that died: "completed" or "undone". Readers of different versions without an intent are an error."""
        text = self.intent.read_text()
        if text is None:
            if len({self.current(t) for t in self.tables}) > 1:
                raise RuntimeError("tables are at different versions, and nothing says which is meant: " + str({t: self.current(t) for t in self.tables}))
            return "consistent"
        plan = json.loads(text)
        if plan["step"] == "ready" and all(self.spark.read.parquet(str(self.folder(plan["version"], t))).count() == n for t, n in plan["rows"].items()):
            for _ in self._switch(plan):
                pass
            return "completed"
        for t in self.tables:
            self._point(t, plan["before"][t])
        (self.root / "versions" / plan["version"]).delete()
        self.intent.delete()
        return "undone"

    def rollback(self, version: str) -> None:
        """Readers get an earlier version; as safe to interrupt as publishing."""
        if version not in self.known():
            raise ValueError(f"there is no version {version}")
        if self.intent.exists():
            raise RuntimeError("another publication is under way or died: recover first")
        rows = {t: self.spark.read.parquet(str(self.folder(version, t))).count() for t in self.tables}
        for _ in self._switch(self._plan(version, "ready", rows=rows)):
            pass

    def migrate(self, version: str, folders: dict[str, str]) -> None:
        """Tables that had no versions become one: their files are moved, not computed again. May be run again after it died."""
        for t in self.tables:
            old = Folder(self.spark, folders[t])
            if old.exists() and not self.folder(version, t).exists():
                (self.root / "versions" / version).make()
                old.moved_to(self.folder(version, t))
        rows = {t: self.spark.read.parquet(str(self.folder(version, t))).count() for t in self.tables}
        for _ in self._switch(self._plan(version, "ready", rows=rows)):
            pass

    def delete(self, version: str) -> bool:
        """False if readers still get it."""
        if version in {self.current(t) for t in self.tables}:
            return False
        (self.root / "versions" / version).delete()
        return True
