"""Tables that are saved: snapshots of several tables under one version, committed whole or not at all.

A store is a folder with snapshots (Parquet, a folder each) and a log with one small file for each version, which names
the snapshots that make it up. A change reads a version, writes its new snapshots, and then claims the next version by
putting a complete log file where none may be: of two writers one gets the version, the other reads what it missed and
applies its change again. So no change is lost, and readers see whole versions only. A change that fails leaves nothing.
Tables that a change doesn't touch are carried on by name, not copied.

Needs a file system on which a rename to a name that is taken fails (HDFS and the like), or a local one, where a link does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stores

TRIES = 50


class Conflict(RuntimeError):
    """Other writers were faster every time."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._hadoop(f"{self.path}/log"))
        self._local = self._fs.getScheme() == "file"

    # --- files

    def _plain(self, path: str) -> str:
        return self._hadoop(path).toUri().getPath()

    def _claim(self, version: int, text: str) -> bool:
        """Put the log file of a version in place, complete, unless it is there."""
        target, made = f"{self.path}/log/{version:012d}.json", f"{self.path}/log/.{uuid.uuid4().hex}"
        out = self._fs.create(self._hadoop(made), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if not self._local:
                return bool(self._fs.rename(self._hadoop(made), self._hadoop(target)))
            os.link(self._plain(made), self._plain(target))
            return True
        except FileExistsError:
            return False
        finally:
            self._delete(made)

    def _delete(self, path: str) -> None:
        self._fs.delete(self._hadoop(path), True)

    def _log(self, version: int) -> dict:
        stream = self._fs.open(self._hadoop(f"{self.path}/log/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # --- reading

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(self._hadoop(f"{self.path}/log")) if f.getPath().getName().endswith(".json") and f.getPath().getName()[:-5].isdecimal())

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the newest if none is told."""
        version = self.version() if version is None else version
        told = self._log(version)["tables"] if version else {}
        return {name: self.spark.read.schema(t["schema"]).parquet(f"{self.path}/{t['at']}") for name, t in told.items()}

    def table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """A table of a version; empty if it has none of this name."""
        found = self.read(version).get(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    # --- writing

    def commit(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], note: str = "", tries: int = TRIES) -> int:
        """Apply a change to the newest version and save what it returns: the tables it touches. It may run again."""
        for _ in range(tries):
            before = self.version()
            old = self._log(before)["tables"] if before else {}
            written = []
            try:
                new = {}
                for name, df in change(self.read(before)).items():
                    at = f"{name}-{uuid.uuid4().hex}"
                    written.append(at)
                    df.write.parquet(f"{self.path}/{at}")
                    new[name] = {"at": at, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
                if self._claim(before + 1, json.dumps({"note": note, "tables": old | new}, ensure_ascii=False)):
                    written = []
                    return before + 1
            finally:
                for at in written:
                    self._delete(f"{self.path}/{at}")
        raise Conflict(f"version {before + 1} of {self.path} was taken {tries} times")

    def forget(self, keep: int = 10) -> None:
        """Delete all versions but the newest ones, and snapshots that only they name. No one may read those any more."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        named = {t["at"] for v in kept for t in self._log(v)["tables"].values()}
        gone = {t["at"] for v in old for t in self._log(v)["tables"].values()} - named
        for v in old:
            self._delete(f"{self.path}/log/{v:012d}.json")
        for at in gone:
            self._delete(f"{self.path}/{at}")


MAPPINGS = "original string, target string, confidence double, created_at string, ord long"
KNOWLEDGE = "source string, target string, table_id string, confidence double, hits long, ord long"
TEMPLATES = "id string, name string, field_ids array<string>, ord long"


def _of(tables: dict[str, DataFrame], name: str, like: DataFrame, schema: str) -> DataFrame:
    return tables[name] if name in tables else like.sparkSession.createDataFrame([], schema)


def save_mappings(store: Store, new: DataFrame) -> int:
    """Mappings in the place of those of one original, and the knowledge base that learns them, in one version.

    new: as MAPPINGS has it. Of an original that is there twice the one of the greatest ord counts.
    """

    def change(tables):
        old, known = _of(tables, "mappings", new, MAPPINGS), _of(tables, "knowledge", new, KNOWLEDGE)
        mappings, learnt = stores.applied(old, new, known)
        columns = [c.split()[0] for c in KNOWLEDGE.split(", ")]
        return {"mappings": mappings.select(*old.columns), "knowledge": learnt.withColumnRenamed("first_seen", "ord").select(columns)}

    return store.commit(change, "mappings")


def save_templates(store: Store, new: DataFrame | None = None, gone: DataFrame | None = None) -> int:
    """Templates by id: new ones or new values, and ids that go."""

    def change(tables):
        old = _of(tables, "templates", new if new is not None else gone, TEMPLATES)
        out = old if new is None else stores.upserted(old, new.select(*old.columns), "id", "ord").select(*old.columns)
        return {"templates": out if gone is None else stores.deleted(out, gone, "id")}

    return store.commit(change, "templates")


def replace_fields(store: Store, fields: DataFrame, name: str = "protocol_fields") -> int:
    """A configuration of fields (id, name, ord) in the place of the one before."""
    return store.commit(lambda tables: {name: fields.select("id", "name", "ord")}, name)


def add_history(store: Store, tasks: DataFrame, created: str = "created_at", tie: str = "task_id", kept: int = stores.KEPT) -> int:
    """Tasks added to the history, of which the newest are kept, without bulky columns."""
    own = tasks.drop(*stores.BULKY)

    def change(tables):
        old = tables.get("history")
        return {"history": stores.history(own if old is None else old.unionByName(own, allowMissingColumns=True), created, tie, kept)}

    return store.commit(change, "history")


def progress(store: Store) -> DataFrame:
    """version and note of what the log holds."""
    rows = [(v, store._log(v)["note"]) for v in store.versions()]
    return store.spark.createDataFrame(rows, "version long, note string").orderBy(F.desc("version"))
