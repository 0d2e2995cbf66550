"""A store of mappings that several writers share: snapshots, each named by a manifest that is made once.

A version is a table of mappings and a manifest with its number.  Who writes version n + 1 has read version n; making
a manifest fails where another one of that number was made before, so of two writers one has to read again.  Tables are
written before they are named: a writer that dies leaves files that no manifest names, and nothing else.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import mappings as M
from veilframe.operators.sessions import expired

SCHEMA = "scope string, type string, idx int, identity string, value string, surface string, written_at timestamp"


#: Seconds after which an empty manifest's writer counts as dead.
ABANDONED = 60


class Conflict(Exception):
    """Another writer has made the version that was to be made."""


class MappingStore:
    def __init__(self, spark: SparkSession, path: str, attempts: int = 20):
        self.spark, self.path, self.attempts = spark, path.rstrip("/"), attempts
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        self._fs, self._path = self._folder.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs.mkdirs(self._folder)

    def version(self) -> int:
        """The last version; 0 is the empty store."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder) if s.getLen()]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))], default=0)

    def manifest(self, version: int) -> dict:
        """What a version holds: {version, table, reason, mappings}."""
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """Mappings of a version, the last one unless named."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.manifest(version)["table"])

    def commit(self, base: int, mappings: DataFrame, reason: str) -> int:
        """Writes mappings as the version behind ``base``; ``Conflict`` if that has been made meanwhile."""
        table = f"{self.path}/tables/{uuid.uuid4().hex}"
        full = mappings
        for c, kind in (x.split(" ") for x in SCHEMA.split(", ")):
            full = full.withColumn(c, F.col(c).cast(kind) if c in mappings.columns else F.current_timestamp() if c == "written_at" else F.lit(None).cast(kind))
        full.select(*(x.split(" ")[0] for x in SCHEMA.split(", "))).write.parquet(table)
        n = self.spark.read.schema(SCHEMA).parquet(table).count()
        body = json.dumps({"version": base + 1, "table": table, "reason": reason, "mappings": n})
        try:
            out = self._fs.create(self._path(f"{self.path}/manifests/{base + 1:012d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                self._abandoned(base + 1)
                raise Conflict(f"version {base + 1} has been made") from None
            raise
        out.write(bytearray(body.encode()))
        out.close()
        return base + 1

    def _abandoned(self, version: int) -> None:
        """Removes a manifest that stayed empty: its writer died before it could fill it."""
        path = self._path(f"{self.path}/manifests/{version:012d}.json")
        status = self._fs.getFileStatus(path)
        if not status.getLen() and time.time() - status.getModificationTime() / 1000 > ABANDONED:
            self._fs.delete(path, False)

    def change(self, make: Callable[[DataFrame], DataFrame], reason: str) -> int:
        """Commits what ``make`` makes of the last version; reads and makes again where another writer was first."""
        for _ in range(self.attempts):
            base = self.version()
            try:
                return self.commit(base, make(self.read(base)), reason)
            except Conflict:
                continue
        raise Conflict(f"{self.attempts} other writers were first")

    def allocate(self, decided: DataFrame) -> int:
        """Numbers the new values of ``decided``; known ones keep theirs."""

        def make(before: DataFrame) -> DataFrame:
            kept = ["scope", "type", "idx", "surface", "written_at"]
            return M.allocate(decided, before).join(before.select(*kept), ["scope", "type", "idx"], "left").withColumn("written_at", F.coalesce("written_at", F.current_timestamp()))

        return self.change(make, "allocate")

    def purge(self, scopes: DataFrame) -> int:
        """A version without the scopes' mappings; versions before keep them until ``vacuum``."""
        return self.change(lambda m: M.purge(m, scopes), "purge")

    def retain(self, seconds: int, now=None) -> int:
        """A version without mappings that have reached an age."""
        now = F.current_timestamp() if now is None else now
        old = lambda m: expired(m, "written_at", now, seconds).select("scope", "type", "idx")
        return self.change(lambda m: m.join(old(m), ["scope", "type", "idx"], "left_anti"), "retain")

    def vacuum(self) -> int:
        """Deletes the tables of all versions but the last, and those that no manifest names; returns how many.

        Purged values are gone then.  Nothing may be reading or committing meanwhile.
        """
        last, gone = self.version(), 0
        kept = self.manifest(last)["table"].rsplit("/", 1)[1] if last else ""
        tables = self._path(f"{self.path}/tables")
        for s in self._fs.listStatus(tables) if self._fs.exists(tables) else []:
            if s.getPath().getName() != kept:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone
