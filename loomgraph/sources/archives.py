"""Members of zip archives, office files among them, as rows: Spark reads the files, the standard library unpacks one member at a time."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MEMBERS = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("member", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])


def members(files: DataFrame, wanted: str = ".*", limit: int | None = None, max_bytes: int = 256 << 20) -> DataFrame:
    """path, ord, member, bytes, error: the members, in archive order, whose name matches ``wanted`` (a pattern), among the
    first ``limit`` of each archive. files: path, content.

    Folders are left out. An archive that cannot be opened gives one row with an error and no member; a member that cannot
    be read, or is larger than ``max_bytes``, gives its row with an error and no bytes.
    """
    import re

    name = re.compile(wanted)

    def of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except Exception as e:
            yield path, None, None, None, str(e)[:200]
            return
        for i, info in enumerate(archive.infolist()[:limit]):
            if info.is_dir() or not name.fullmatch(info.filename):
                continue
            try:
                if info.file_size > max_bytes:
                    raise ValueError(f"larger than {max_bytes} bytes")
                yield path, i, info.filename, archive.read(info), None
            except Exception as e:
                yield path, i, info.filename, None, str(e)[:200]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in of(path.as_py(), content.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, MEMBERS.types, strict=True)], schema=MEMBERS)

    return files.select("path", "content").mapInArrow(work, "path string, ord int, member string, bytes binary, error string")


def expanded(files: DataFrame, limit: int | None = 200) -> DataFrame:
    """path, ord, name, content of the files in zip archives, without what operating systems leave; the first ``limit``
    members of each archive are looked at (None: all)."""
    found = members(files, limit=limit).filter("bytes is not null")
    return found.filter(~T.junk(F.col("member"))).select("path", "ord", F.col("member").alias("name"), F.col("bytes").alias("content"))
