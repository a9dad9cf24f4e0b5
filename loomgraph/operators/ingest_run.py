"""Ingest from files to ``raw/<id>/`` in one plan: members, grouping, conversion, figures, deduplication, storing.

A file is an input of its own; files that share a ``batch`` are one (a folder). A zip archive is
opened, and its members are a batch. In a batch with documents, loose images are figures of the
longest document; elsewhere every image is a source. Content that the bundle has, or that came
earlier in the same run, is not stored again. The bytes of loose images go to storage as rows;
what is put together for a source is its text, its metadata and the figures inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import archives, raw, raw_store
from ..sources.tables import materialise
from . import ingest, office

RECORD = ["batch", "name", "id", "title", "format", "needs_llm", "action"]


def members(files: DataFrame, member_cap: int | None = ingest.MEMBER_CAP) -> DataFrame:
    """batch, ord, name, content of what is to be ingested. files: path, content, and batch where several are one input.

    Hidden files and what operating systems leave go. ``member_cap`` is how many members of an archive are looked at (None:
    all).
    """
    of = files.withColumn("batch", F.coalesce("batch", "path")) if "batch" in files.columns else files.withColumn("batch", F.col("path"))
    shown = of.filter(~T.junk(F.col("path")) & ~F.startswith(F.regexp_extract("path", "([^/]*)$", 1), F.lit(".")))
    zipped = F.lower(T.path_extension(F.col("path"))) == "zip"
    plain = shown.filter(~zipped).select("batch", F.col("path").alias("ord"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")
    unpacked = archives.expanded(shown.filter(zipped).select("path", "content"), member_cap)
    return plain.unionByName(unpacked.select(F.col("path").alias("batch"), F.format_string("%010d", "ord").alias("ord"), "name", "content"))


def _base(name: str) -> Column:
    return F.regexp_extract(name, "([^/]*)$", 1)


def combined(parts: DataFrame) -> DataFrame:
    """The members of each batch as one text, where there are several: batch, ord, name, content."""
    each = parts.select(F.concat_ws("\t", "batch", "ord").alias("path"), F.lower(T.path_extension(F.col("name"))).alias("ext"), F.col("name").alias("filename"), "content", "batch", "ord", "name")
    joined = ingest.combined(office.convert(each, None).withColumn("markdown", T.strip(F.col("markdown"))), None)
    several = materialise(parts.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("batch"), "combined-batches")
    one = joined.join(several, "batch", "left_semi").select("batch", F.lit("").alias("ord"), F.lit("combined.md").alias("name"), F.concat("markdown", F.lit("\n\n")).cast("binary").alias("content"))
    return one.unionByName(parts.join(several, "batch", "left_anti").select("batch", "ord", "name", "content"))


def prepared(parts: DataFrame, existing: DataFrame, marker: str = ingest.MARKER) -> tuple[DataFrame, DataFrame]:
    """(sources, loose): sources have RECORD, path, ext, sha256, markdown, content, found, figures; loose have path (of the
    source they belong to), name (of the figure) and bytes. existing: id, sha256."""
    placed = materialise(ingest.grouped(parts.select(F.col("batch").alias("folder"), "ord", _base("name").alias("name"), F.octet_length("content").cast("long").alias("length"), F.col("name").alias("member"))), "ingest-roles")
    key = lambda batch, order: F.concat_ws("\t", batch, order)
    docs = placed.filter("role <> 'figure'").select(key("folder", "ord").alias("path"), F.col("folder").alias("batch"), F.col("ord").alias("o"), F.col("name").alias("filename"))
    base = docs.join(parts.select(key("batch", "ord").alias("_key"), "content"), F.col("path") == F.col("_key")).drop("_key").withColumn("ext", F.lower(T.path_extension(F.col("filename")))).withColumn("sha256", F.sha2("content", 256))
    known = ingest.deduplicate(base.withColumn("ord", F.col("path")), existing)
    known = materialise(known, "ingest-known")
    fresh = known.filter("action = 'stored'").select("path", "batch", "filename", "ext", "content", "sha256")
    read = office.convert(fresh, None).withColumn("title", T.title_from(F.col("markdown"), F.col("filename"), F.lit(None).cast("string")))
    inside = office.with_figures(read, marker)  # with its banner, which is put on anew below
    loose = placed.filter("role = 'figure'").select(key("folder", "primary_ord").alias("_path"), F.struct("ord", F.lower(T.path_extension(F.col("name"))).alias("ext"), "member", key("folder", "ord").alias("key")).alias("x"))
    listed = materialise(loose.groupBy("_path").agg(F.array_sort(F.collect_list("x")).alias("_loose")), "ingest-loose")  # names of one source's figures, no bytes
    several = inside.join(listed, F.col("path") == F.col("_path"), "left").drop("_path").withColumn("_first", F.col("figures")).withColumn("_inside", F.col("found"))
    plain = F.when(F.startswith("markdown", F.lit(marker)), F.substring("markdown", len(marker) + 3, 2**31 - 1)).otherwise(F.col("markdown"))
    origin = F.transform(F.coalesce("_loose", F.array().cast("array<struct<ord:string,ext:string,member:string,key:string>>")), lambda x: F.struct(x["ext"].alias("ext"), F.lit(None).cast("binary").alias("bytes"), F.concat(F.lit("folder:"), x["member"]).alias("origin")))
    whole = ingest.figures_written(several.withColumn("body", plain).withColumn("found", origin), F.size("_inside"))
    whole = whole.withColumn("figures", F.concat("_first", "figures")).withColumn("found", F.col("_inside")).withColumn("markdown", F.col("body"))
    stored = ingest.with_banner(whole, marker).withColumn("id", T.source_id(F.col("title"), F.col("content")))
    sources = stored.select("batch", F.col("filename").alias("name"), "id", "title", "format", "needs_llm", F.lit("stored").alias("action"), "path", "ext", "sha256", "markdown", "content", "found", "figures")
    sources = materialise(sources, "ingest-sources")
    order = listed.select(F.col("_path").alias("path"), F.posexplode("_loose").alias("k", "x")).select("path", "k", F.col("x.key").alias("_key"))
    named = order.join(sources.select("path", "id", "figures", F.size("found").alias("_n")), "path").select("path", "id", "_key", F.get("figures", F.col("_n") + F.col("k"))["file"].alias("name"))
    figures = named.join(parts.select(key("batch", "ord").alias("_key"), F.col("content").alias("bytes")), "_key").select("path", "id", "name", "bytes")
    others = known.filter("action <> 'stored'").select("batch", F.col("filename").alias("name"), "path", "sha256", "existing_id", "action")
    return sources.unionByName(others.select("batch", "name", F.col("existing_id").alias("id"), "action", "path", "sha256"), allowMissingColumns=True), figures


def stored_files(sources: DataFrame, loose: DataFrame) -> DataFrame:
    """id, name, bytes of every file of new sources: the original, its text, its metadata, its figures."""
    fresh = sources.filter("action = 'stored'")
    meta = F.to_json(
        F.struct(
            "id", "title", "sha256", "format", F.col("name").alias("original_filename"), T.today().cast("string").alias("ingested_at"), F.col("needs_llm").alias("needs_llm_fallback"),
            F.transform("figures", lambda x: F.struct(x["file"].alias("file"), x["provisional"].alias("provisional"), x["described"].alias("described"), x["origin"].alias("origin"))).alias("figures"),
        )
    )
    file = lambda name, content: F.struct(name.alias("name"), content.cast("binary").alias("bytes"))
    own = F.array(
        file(F.concat(F.lit("original."), F.when(F.col("ext") == "", "bin").otherwise(F.col("ext"))), F.col("content")),
        file(F.lit("source.md"), F.col("markdown")),
        file(F.lit("meta.yaml"), F.concat(meta, F.lit("\n"))),
    )
    inside = F.transform("found", lambda x, i: F.struct(F.get("figures", i)["file"].alias("name"), x["bytes"].alias("bytes")))
    return fresh.select("id", F.inline(F.concat(own, inside))).unionByName(loose.select("id", "name", "bytes"))


def ingest_files(files: DataFrame, root: str, combine: bool = False, marker: str = ingest.MARKER, member_cap: int | None = ingest.MEMBER_CAP) -> DataFrame:
    """RECORD of every source that ``files`` (path, content, batch where several are one input) hold; new ones are stored in
    the bundle at ``root``. An action is ``stored``, ``reused`` (the bundle has the content, under the id told) or
    ``repeated`` (an earlier source of this run has it)."""
    parts = materialise(members(files, member_cap), "ingest-members")
    if combine:
        parts = materialise(combined(parts), "ingest-members")
    sources, loose = prepared(parts, existing(files.sparkSession, root), marker)
    raw_store.publish(stored_files(sources, loose), root)
    first = sources.filter("action = 'stored'").select("sha256", F.col("id").alias("_id"), F.col("title").alias("_title"))
    return sources.join(first, "sha256", "left").withColumn("id", F.coalesce("id", "_id")).withColumn("title", F.coalesce("title", "_title", "id")).withColumn("needs_llm", F.coalesce("needs_llm", F.lit(False))).select(*RECORD)


def existing(spark, root: str) -> DataFrame:  # noqa: ANN001
    """id, sha256 of the bundle's sources; none where it has none yet."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/raw")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder) or not any(not s.getPath().getName().startswith(".") for s in files.listStatus(folder)):
        return spark.createDataFrame([], "id string, sha256 string")
    return raw.metadata(spark, root).filter("error is null").select("id", F.col("meta.sha256").alias("sha256"))
