"""A table in versions: written data that never changes, and one manifest for each version.

A manifest names the folders of Parquet files that make up a version, its parent, kind and
summary, and how many rows it adds and removes. It is written apart and then renamed to its
number, which fails where that number is taken: of two writers who began at the same version the
first to commit wins, and the other is told (``Conflict``). Readers see whole versions only; what
is staged and never committed is in no manifest. Restoring copies a manifest, not data.

The driver handles manifests, whose size follows the number of commits, never rows.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A manifest as a row of the log.
MANIFEST = "version long, parent long, kind string, summary string, at timestamp, added long, removed long, folders array<string>, schema string"


class Conflict(Exception):
    """Another writer has committed since this one began."""


class VersionedTable:
    """A folder of versions; the first commit makes version 1."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- files, by Hadoop's interface: any store that Spark reads

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self) -> list[int]:
        folder = self._path("manifests")
        if not self._files().exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._files().listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _publish(self, manifest: dict) -> None:
        """The manifest under its number, whole or not at all."""
        files, apart, place = self._files(), self._path("apart", f"{uuid.uuid4().hex}.json"), self._path("manifests", f"{manifest['version']:012}.json")
        out = files.create(apart, False)
        out.write(bytearray((json.dumps(manifest) + "\n").encode()))
        out.close()
        files.mkdirs(place.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), files.getConf())
        try:
            context.rename(files.makeQualified(apart), files.makeQualified(place), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))  # never onto a file
        except Py4JJavaError as e:
            if files.exists(place):
                files.delete(apart, False)
                raise Conflict(f"version {manifest['version']} was committed by another writer") from e
            raise

    def manifest(self, version: int) -> dict:
        row = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/{version:012}.json").first()
        if row is None:
            raise ValueError(f"there is no version {version}")
        return row.asDict() | {"at": row["at"].isoformat()}

    # --- reading

    def latest(self) -> int:
        """The newest version; 0 where there is none."""
        return max(self._numbers(), default=0)

    def log(self) -> DataFrame:
        """version, parent, kind, summary, at, added, removed of every version."""
        if not self._numbers():
            return self.spark.createDataFrame([], MANIFEST).drop("folders", "schema")
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests").drop("folders", "schema")

    def read(self, version: int | None = None) -> DataFrame:
        """A version as it was committed (the newest, if none is named)."""
        number = self.latest() if version is None else version
        if number not in self._numbers():
            raise ValueError(f"there is no version {number}")
        return self._rows(self.manifest(number))

    def _rows(self, manifest: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not manifest["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in manifest["folders"]))

    # --- writing

    def begin(self) -> Staging:
        return Staging(self, self.latest())

    def commit(self, df: DataFrame, kind: str, summary: str) -> int:
        """``df`` as the newest version; nothing happens where it holds what the newest holds already."""
        staged = self.begin()
        staged.replace(df)
        return staged.commit(kind, summary)

    def restore(self, version: int, summary: str | None = None) -> int:
        """The rows of an old version as the newest one: restoring only ever moves forward."""
        if version not in self._numbers():
            raise ValueError(f"there is no version {version}")
        old, newest = self.manifest(version), self.latest()
        self._publish(old | {"version": newest + 1, "parent": newest, "kind": "restore", "summary": summary or f"version {version}", "at": _now(self.spark), "added": None, "removed": None})
        return newest + 1


class Staging:
    """What one writer has written since version ``base``, not yet part of any version. Several writes are one commit."""

    def __init__(self, table: VersionedTable, base: int) -> None:
        self.table, self.base, self.open = table, base, True
        found = table.manifest(base) if base else {"folders": [], "schema": None}
        self.folders, self.schema, self.written, self.only_adds = list(found["folders"]), found["schema"], [], True

    def _write(self, df: DataFrame) -> None:
        if not self.open:
            raise ValueError("this staging has been committed or aborted")
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.table.root}/data/{folder}")
        self.written.append(folder)
        self.schema = self.schema or df.schema.json()

    def append(self, df: DataFrame) -> None:
        """Further rows, in the order of the table's columns."""
        if self.schema:
            df = df.select(*StructType.fromJson(json.loads(self.schema)).names)
        self._write(df)
        self.folders.append(self.written[-1])

    def replace(self, df: DataFrame) -> None:
        """All rows anew; the schema may change."""
        self.schema, self.only_adds = None, False
        self._write(df)
        self.folders = [self.written[-1]]

    def read(self) -> DataFrame:
        """What a commit would make."""
        return self.table._rows({"folders": self.folders, "schema": self.schema})

    def _delta(self) -> tuple[int, int]:
        """Rows added and removed."""
        if self.only_adds:
            return sum(self.table._rows({"folders": [f], "schema": self.schema}).count() for f in self.written), 0
        new = self.read()
        if not self.base:
            return new.count(), 0
        old = self.table.read(self.base)
        if old.schema != new.schema:
            return new.count(), old.count()
        return new.exceptAll(old).count(), old.exceptAll(new).count()

    def commit(self, kind: str, summary: str) -> int:
        """The new version's number; that of the base where nothing has changed."""
        if not self.open:
            raise ValueError("this staging has been committed or aborted")
        added, removed = self._delta() if self.written else (0, 0)
        if not added and not removed and (self.base or not self.written):
            self.abort()
            return self.base
        number = self.base + 1
        self.open = False
        try:
            self.table._publish({"version": number, "parent": self.base, "kind": kind, "summary": summary, "at": _now(self.table.spark), "added": added, "removed": removed, "folders": self.folders, "schema": self.schema})
        except Conflict:
            self.abort()
            raise
        return number

    def abort(self) -> None:
        """Nothing of what was staged stays."""
        self.open = False
        for folder in self.written:
            self.table._files().delete(self.table._path("data", folder), True)


def _now(spark: SparkSession) -> str:
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).first()[0]
