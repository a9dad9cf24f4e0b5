"""Writing ``raw/<id>/``: a data source that stages files and publishes whole sources.

Rows are files (id, name, bytes). Tasks write them below a hidden staging folder, each under a
name of its own until it is complete; only when every task has ended are the staged folders
renamed to ``raw/<id>``, one rename for each source, by the driver. A failed task is run again
and writes the same files; a failed job leaves neither sources nor its staging folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FILES = "id string, name string, bytes binary"


def _open(root: str):  # noqa: ANN202
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _safe(part: str) -> bool:
    return bool(part) and not any(x in ("", ".", "..") for x in part.split("/"))


@dataclass
class Staged(WriterCommitMessage):
    ids: list[str]


class RawStoreWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root, self.staging = root.rstrip("/"), f"raw/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, base = _open(self.root)
        ids = set()
        for row in iterator:
            if not _safe(row["id"]) or "/" in row["id"] or not _safe(row["name"]):
                raise ValueError(f"not the name of a file in a source's folder: {row['id']}/{row['name']}")
            place = f"{base}/{self.staging}/{row['id']}/{row['name']}"
            files.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(part := f"{place}.part-{uuid.uuid4().hex}") as out:
                out.write(bytes(row["bytes"] or b""))
            files.move(part, place)
            ids.add(row["id"])
        return Staged(sorted(ids))

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileType

        files, base = _open(self.root)
        ids = sorted({i for m in messages if m for i in m.ids})
        for found in files.get_file_info([f"{base}/raw/{i}" for i in ids]) if ids else []:
            if found.type != FileType.NotFound:
                self.abort(messages)
                raise ValueError(f"there is a source at {found.path} already")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda i: files.move(f"{base}/{self.staging}/{i}", f"{base}/raw/{i}"), ids))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileType

        files, base = _open(self.root)
        if files.get_file_info(f"{base}/{self.staging}").type != FileType.NotFound:
            files.delete_dir(f"{base}/{self.staging}")


class RawStore(DataSource):
    """``raw_store``: appends sources to the bundle at the path given."""

    @classmethod
    def name(cls) -> str:
        return "raw_store"

    def schema(self) -> str:
        return FILES

    def writer(self, schema: StructType, overwrite: bool) -> RawStoreWriter:
        if overwrite:
            raise ValueError("raw sources are never overwritten")
        return RawStoreWriter(self.options["path"])


def publish(files: DataFrame, root: str) -> None:
    """Add the sources whose files (id, name, bytes) these are to the bundle."""
    files.sparkSession.dataSource.register(RawStore)
    files.select("id", "name", "bytes").write.format("raw_store").mode("append").save(root)
