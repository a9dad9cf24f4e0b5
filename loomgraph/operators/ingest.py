"""Ingest: identity by content, format conversion in column expressions, deduplication, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import materialise

#: What stands before a text that still waits to be rendered; knowledge bases may use another (a parameter).
MARKER = "<!-- needs conversion -->"
# Formats by extension.
TEXT_FORMATS = ["md", "markdown", "txt", "text", "", "xml", "yaml", "yml", "rst", "log", "tex", "org"]
IMAGE_FORMATS = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif", "svg"]
# What the conversion keeps at most; each is a parameter, and None lifts it.
ROW_CAP, CHAR_CAP, MEMBER_CAP = 500, 8000, 200


def table_markdown(text: Column, delimiter: str = ",", row_cap: int | None = ROW_CAP) -> Column:
    """Delimited lines as a Markdown table: blank lines go, the first line heads it, ``row_cap`` further rows at most."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: T.strip(x) != "")
    row = lambda x: F.concat(F.lit("| "), F.array_join(T.split_delimited(x, delimiter), " | "), F.lit(" |\n"))
    head = F.get(lines, 0)
    rule = F.concat(F.lit("|"), F.array_join(F.transform(T.split_delimited(head, delimiter), lambda _: F.lit(" --- |")), ""), F.lit("\n"))
    body = F.array_join(F.transform(F.slice(lines, F.lit(2), F.lit(row_cap) if row_cap is not None else F.greatest(F.size(lines), F.lit(0))), row), "")
    more = F.when(F.size(lines) > row_cap + 1, f"\n_(truncated at {row_cap} rows)_\n").otherwise("") if row_cap is not None else F.lit("")
    return F.when(F.size(lines) > 0, F.concat(row(head), rule, body, more)).otherwise("")


def decoded(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def convert(sources: DataFrame, marker: str | None = MARKER, row_cap: int | None = ROW_CAP, char_cap: int | None = CHAR_CAP) -> DataFrame:
    """ext, filename, content (binary) -> markdown, format, needs_llm; without a marker, no banner. ``office.convert`` does the
    same and decodes office files as well; here they are left with a note."""
    text = decoded(F.col("content"))
    ext = F.lower("ext")
    shown = text if char_cap is None else F.left(text, F.lit(char_cap))
    markdown = (
        F.when(ext.isin(TEXT_FORMATS), text)
        .when(ext == "json", F.concat(F.lit("```json\n"), F.rtrim(text, F.lit(T.WHITE)), F.lit("\n```\n")))
        .when(ext == "csv", table_markdown(text, ",", row_cap))
        .when(ext == "tsv", table_markdown(text, "\t", row_cap))
        .when(ext.isin("html", "htm"), T.strip_markup(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", ""), r"(?i)</(p|div|h[1-6]|li|tr)>|<br\s*/?>", "\n\n")))
        .when(ext.isin(IMAGE_FORMATS), F.concat(F.lit("!["), F.col("filename"), F.lit("](figures/"), F.col("filename"), F.lit(")\n")))
        .when(ext == "pdf", F.concat(F.lit("> A PDF, `"), F.col("filename"), F.lit("`: its pages are to be read and written out, with text, formulas and figures.\n")))
        .otherwise(F.concat(F.lit("Unknown format `."), ext, F.lit("` (`"), F.col("filename"), F.lit("`), as far as it is text:\n\n```\n"), F.rtrim(shown, F.lit(T.WHITE)), F.lit("\n```\n")))
    )
    read = TEXT_FORMATS + ["json", "csv", "tsv", "html", "htm"]
    needs = ~ext.isin(read)
    kind = F.when(ext.isin(TEXT_FORMATS), "text").when(ext.isin("tsv"), "csv").when(ext == "htm", "html").when(ext.isin(IMAGE_FORMATS), "image").otherwise(ext)
    out = sources.withColumn("markdown", markdown).withColumn("format", kind).withColumn("needs_llm", needs)
    return out if marker is None else with_banner(out, marker)


def with_banner(sources: DataFrame, marker: str = MARKER) -> DataFrame:
    """The marker before the markdown of what needs rendering: an unread format, or any figure."""
    needs = F.col("needs_llm") if "figures" not in sources.columns else F.col("needs_llm") | (F.size("figures") > 0)
    plain = F.when(F.col("markdown").startswith(marker), F.substring("markdown", len(marker) + 3, 2**31 - 1)).otherwise(F.col("markdown"))
    return sources.withColumn("needs_llm", needs).withColumn("markdown", F.when(F.col("needs_llm"), F.concat(F.lit(marker + "\n\n"), plain)).otherwise(plain))


def inline_sources(texts: DataFrame) -> DataFrame:
    """title, text -> filename, ext, content: texts given in place of files."""
    name = F.concat(F.coalesce(F.nullif(T.slug(F.col("title")), F.lit("")), F.lit("source")), F.lit(".md"))
    return texts.select(name.alias("filename"), F.lit("md").alias("ext"), F.col("text").cast("binary").alias("content"), "title")


#: An image inside a text, as base64.
DATA_URI = r"data:image/([a-z0-9.+-]++);base64,([A-Za-z0-9+/=]++)"


def _image_ext(kind: Column) -> Column:
    return F.when(kind == "jpeg", "jpg").when(kind == "svg+xml", "svg").otherwise(kind)


def _figure_name(n: Column, ext: Column) -> Column:
    return F.concat(F.lit("fig-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def figures_apart(sources: DataFrame) -> DataFrame:
    """body with every base64 image replaced by figures/fig-NNN.ext, and found: array of (ext, bytes, origin) in order. One
    that cannot be decoded stays where it is."""
    body = F.col("body")
    part = lambda g: F.regexp_extract_all(body, F.lit(DATA_URI), F.lit(g))
    images = F.arrays_zip(part(0).alias("whole"), part(1).alias("kind"), F.transform(part(2), lambda x: F.try_to_binary(x, F.lit("base64"))).alias("bytes"))
    rows = sources.withColumn("_images", images).withColumn("_gaps", F.split(body, DATA_URI, -1))
    nth = lambda i: F.size(F.filter(F.slice("_images", F.lit(1), i + 1), lambda x: x["bytes"].isNotNull()))
    shown = F.transform("_images", lambda x, i: F.concat(F.get("_gaps", i), F.when(x["bytes"].isNull(), x["whole"]).otherwise(F.concat(F.lit("figures/"), _figure_name(nth(i), _image_ext(x["kind"]))))))
    found = F.transform(F.filter("_images", lambda x: x["bytes"].isNotNull()), lambda x: F.struct(_image_ext(x["kind"]).alias("ext"), x["bytes"].alias("bytes"), F.lit("data-uri").alias("origin")))
    return rows.withColumn("found", found).withColumn("body", F.concat(F.array_join(shown, ""), F.element_at("_gaps", -1))).drop("_images", "_gaps")


def figures_written(sources: DataFrame, start: int | Column = 0) -> DataFrame:
    """body and found (ext, bytes, origin) -> figures: array of (file, provisional, described, origin), numbered on from
    ``start``; a figure that the body does not name yet is shown at its end."""
    named = F.transform("found", lambda x, i: F.struct(_figure_name(i + 1 + start, F.lower(x["ext"])).alias("name"), x["origin"].alias("origin")))
    meta = F.transform(named, lambda x: F.struct(F.concat(F.lit("figures/"), x["name"]).alias("file"), F.lit(True).alias("provisional"), F.lit(False).alias("described"), x["origin"].alias("origin")))
    new = F.filter(named, lambda x: ~F.col("body").contains(F.concat(F.lit("figures/"), x["name"])))
    shown = F.array_join(F.transform(new, lambda x: F.concat(F.lit("\n!["), x["name"], F.lit("](figures/"), x["name"], F.lit(")\n"))), "")
    end = F.when((F.size(new) > 0) & ~F.col("body").endswith("\n"), "\n").otherwise("")
    return sources.withColumn("figures", meta).withColumn("body", F.concat("body", end, shown))


def data_uri_figures(sources: DataFrame) -> DataFrame:
    """id, n, ext, bytes of every base64 image inside the body; one that cannot be decoded is left out."""
    rows = figures_apart(sources).select("id", F.posexplode("found").alias("i", "f"))
    return rows.select("id", (F.col("i") + 1).alias("n"), "f.ext", "f.bytes")


def deduplicate(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming: ord, sha256; existing: id, sha256. Adds existing_id, first_ord and action: reused, repeated or stored.

    The first of equal content in a batch is a combined minimum per hash, so copies meet as one row. What is known of a
    hash is written before it is looked up, so that adaptive execution splits the rows of a hot one.
    """
    first = incoming.groupBy("sha256").agg(F.min("ord").alias("first_ord"))
    old = existing.groupBy("sha256").agg(F.min("id").alias("existing_id"))
    known = materialise(first.join(old, "sha256", "left"), "known")
    return incoming.join(known, "sha256").withColumn("action", F.when(F.col("existing_id").isNotNull(), "reused").when(F.col("ord") > F.col("first_ord"), "repeated").otherwise("stored"))


def url_then_content(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming: url, sha256; existing: id, url, sha256. reused_id by URL first, then by content."""
    by_url = materialise(existing.filter("url is not null").groupBy("url").agg(F.min("id").alias("by_url")), "known-urls")
    by_sha = materialise(existing.groupBy("sha256").agg(F.min("id").alias("by_sha")), "known-hashes")
    return incoming.join(by_url, "url", "left").join(by_sha, "sha256", "left").withColumn("reused_id", F.coalesce("by_url", "by_sha")).drop("by_url", "by_sha")


def combined(members: DataFrame, member_cap: int | None = MEMBER_CAP) -> DataFrame:
    """batch, ord, name, markdown -> one markdown per batch (of its first ``member_cap`` members; None: of all), and whether
    any needs conversion."""
    few = members
    if member_cap is not None:
        few = members.withColumn("_nth", F.row_number().over(Window.partitionBy("batch").orderBy("ord"))).filter(F.col("_nth") <= member_cap)
    part = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), F.col("markdown"))
    return few.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"), F.bool_or("needs_llm").alias("needs_llm")).select("batch", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("markdown"), "needs_llm")


def grouped(members: DataFrame) -> DataFrame:
    """folder, ord, name, length -> with role: in a folder that holds a document, the longest is ``primary`` (of equals the
    last), others ``document``, and loose images are ``figure`` of the primary (primary_ord); elsewhere images are sources
    of their own (``image``)."""
    image = F.lower(T.path_extension(F.col("name"))).isin(IMAGE_FORMATS)
    best = members.filter(~image).groupBy("folder").agg(F.max(F.struct("length", "ord")).alias("b")).select("folder", F.col("b.ord").alias("primary_ord"))
    role = F.when(image & F.col("primary_ord").isNull(), "image").when(image, "figure").when(F.col("ord") == F.col("primary_ord"), "primary").otherwise("document")
    return members.join(best, "folder", "left").withColumn("role", role)


def primary_document(members: DataFrame) -> DataFrame:
    """folder, ord, length -> the longest document of each folder; of equals the last."""
    return members.groupBy("folder").agg(F.max(F.struct("length", "ord")).alias("best")).select("folder", F.col("best.ord").alias("ord"), F.col("best.length").alias("length"))


def name_figure(sources: DataFrame, source: str, old: str, new: str) -> DataFrame:
    """Rename a figure of one source: in its list (no longer provisional) and in its text."""
    here = F.col("id") == source
    renamed = F.transform("figures", lambda f: F.when(f["file"] == old, F.struct(F.lit(new).alias("file"), F.lit(False).alias("provisional"))).otherwise(F.struct(f["file"].alias("file"), f["provisional"].alias("provisional"))))
    return sources.withColumn("figures", F.when(here, renamed).otherwise(F.col("figures"))).withColumn("body", F.when(here, F.replace("body", F.lit(f"figures/{old}"), F.lit(f"figures/{new}"))).otherwise(F.col("body")))
