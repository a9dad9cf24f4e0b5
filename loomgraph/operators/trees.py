"""Snapshots compared by the digests of their folders: what is alike is not read.

A snapshot is the files of a base (path, identifier, sha256), stored by folder, and one row for
each folder with two digests: of the files that lie in it, and of all below it. Digests combine
in any order, so every folder is one aggregate, combined before its shuffle. A comparison goes
down from the root, one level at a time, into folders whose digests differ; files are read of
folders only whose own digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialise


#: Folders that are named to the reader at most.
LISTED = 1000
#: Stored files; the part is text, whatever its digits look like.
FILES = "path string, identifier string, sha256 string, folder string, part string"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _digest(where: Column | None = None) -> list[Column]:
    """How many files, and what they are, in any order."""
    of = lambda c: c if where is None else F.when(where, c)
    return [F.count(of(F.lit(1))).alias("n"), *(F.bit_xor(of(F.xxhash64(F.lit(i), "path", "identifier", "sha256"))).alias(f"d{i}") for i in (1, 2))]


def _alike(one: str, two: str) -> Column:
    """Whether two digests are of the same files; no folder is like one without files."""
    n = lambda c: F.coalesce(F.col(f"{c}.n"), F.lit(0))
    return (n(one) == n(two)) & F.col(f"{one}.d1").eqNullSafe(F.col(f"{two}.d1")) & F.col(f"{one}.d2").eqNullSafe(F.col(f"{two}.d2"))


def write_tree(files: DataFrame, root: str) -> None:
    """Store a snapshot of ``files`` (path, identifier, sha256) at ``root``."""
    rows = files.select("path", "identifier", "sha256").withColumn("folder", _folder(F.col("path")))
    # A folder's name is stored under its hash: it may hold anything, and be the empty one.
    stored = rows.withColumn("part", F.hex(F.xxhash64("folder")))
    stored.write.partitionBy("part").parquet(f"{root}/files")
    read = files.sparkSession.read.schema(FILES).parquet(f"{root}/files")
    steps = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))))
    each = read.select("path", "identifier", "sha256", "folder", F.posexplode(above).alias("depth", "above"))
    own = F.col("folder") == F.col("above")
    level = each.groupBy("depth", "above").agg(F.struct(*_digest()).alias("below"), F.struct(*_digest(own)).alias("own"))
    level.select(F.col("above").alias("folder"), _folder(F.col("above")).alias("parent"), "below", "own", "depth").write.partitionBy("depth").parquet(f"{root}/folders")


def changed_folders(spark: SparkSession, before: str, after: str) -> DataFrame:
    """folder of all whose own files differ between two snapshots."""
    trees = [spark.read.parquet(f"{root}/folders") for root in (before, after)]
    found, inside, depth = None, None, 0
    while True:
        a, b = (t.filter(F.col("depth") == depth).select("folder", "parent", "below", "own") for t in trees)
        if inside is not None:
            a, b = (t.join(inside.select(F.col("folder").alias("parent")), "parent", "left_semi") for t in (a, b))
        both = a.alias("a").join(b.alias("b"), "folder", "full").filter(~_alike("a.below", "b.below"))
        inside = materialise(both.select("folder", (~_alike("a.own", "b.own")).alias("own")), "changed-folders")
        found = inside if found is None else found.unionByName(inside)
        if inside.isEmpty():
            return found.filter("own").select("folder")
        depth += 1


def files_in(spark: SparkSession, root: str, folders: DataFrame) -> DataFrame:
    """path, identifier, sha256 of the files of a snapshot in ``folders``. Up to LISTED folders are named to the reader, which
    then opens no other; more are joined."""
    parts = folders.select("folder", F.hex(F.xxhash64("folder")).alias("part"))
    stored, few = spark.read.schema(FILES).parquet(f"{root}/files"), parts.select("part").distinct().limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        stored = stored.filter(F.col("part").isin([r["part"] for r in few]))
    return stored.join(parts, ["part", "folder"], "left_semi").select("path", "identifier", "sha256")


def tree_diff(spark: SparkSession, before: str, after: str) -> DataFrame:
    """path, issue, new_path of all that differs between two snapshots.

    A file with other content at its path is ``changed``. One that is gone is ``moved`` where a new file bears its
    identifier, else ``renamed`` where a new one has its content, else ``removed``; new_path is the first such file. A new
    file that no gone one explains is ``added``.
    """
    folders = materialise(changed_folders(spark, before, after), "changed-folders")
    old, new = (materialise(files_in(spark, root, folders), "tree-files") for root in (before, after))
    there = lambda df: df.select("path").distinct()
    gone, came = old.join(there(new), "path", "left_anti"), materialise(new.join(there(old), "path", "left_anti"), "new-files")
    by_name = materialise(came.groupBy("identifier").agg(F.min("path").alias("moved")), "new-identifiers")
    by_content = materialise(came.groupBy("sha256").agg(F.min("path").alias("renamed")), "new-contents")
    issue = F.when(F.col("moved").isNotNull(), "moved").when(F.col("renamed").isNotNull(), "renamed").otherwise("removed")
    left = gone.join(by_name, "identifier", "left").join(by_content, "sha256", "left").select("path", issue.alias("issue"), F.coalesce("moved", "renamed").alias("new_path"))
    told = materialise(gone.select("identifier", "sha256"), "gone-files")
    added = came.join(told.select("identifier").distinct(), "identifier", "left_anti").join(told.select("sha256").distinct(), "sha256", "left_anti")
    none = F.lit(None).cast("string").alias("new_path")
    changed = old.alias("o").join(new.alias("n"), "path").filter("o.sha256 <> n.sha256 or not o.identifier <=> n.identifier").select("path", F.lit("changed").alias("issue"), none)
    return left.unionByName(added.select("path", F.lit("added").alias("issue"), none)).unionByName(changed)
