"""Office files and web pages to Markdown: members come from ``sources.archives``, and their text from column expressions;
Python reads a sheet's cells and a page's structure, one document at a time."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..sources import archives
from . import ingest

# Where office files keep their images.
MEDIA = {"docx": "word/media/", "pptx": "ppt/media/", "xlsx": "xl/media/", "ods": "xl/media/"}
OFFICE = ["docx", "pptx", "xlsx", "xls", "ods"]


def _xml_text(part: Column, paragraph: str) -> Column:
    return T.strip_markup(F.replace(ingest.decoded(part), F.lit(paragraph), F.lit("\n\n")))


def documents(files: DataFrame) -> DataFrame:
    """path, markdown, error of word processor files."""
    found = archives.members(files, r"word/document\.xml")
    each = found.groupBy("path").agg(F.max("bytes").alias("part"), F.max("error").alias("error"))
    paths = files.select("path").distinct()
    return paths.join(each, "path", "left").select("path", _xml_text(F.col("part"), "</w:p>").alias("markdown"), F.when(F.col("part").isNull(), F.coalesce("error", F.lit("no document part"))).alias("error"))


def slides(files: DataFrame) -> DataFrame:
    """path, markdown, error of presentations: slides in the order of their numbers, each that has text under its place."""
    found = archives.members(files, r"ppt/slides/slide.*\.xml|\[Content_Types\]\.xml")
    number = F.coalesce(F.regexp_extract("member", r"slide([0-9]+)\.xml$", 1).try_cast("int"), F.lit(0))
    is_slide = F.col("member").startswith("ppt/slides/slide")
    one = F.when(is_slide, F.struct(number.alias("number"), "ord", _xml_text(F.col("bytes"), "</a:p>").alias("text")))
    each = found.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("slides"), F.max(F.when(F.col("member").isNull(), F.col("error"))).alias("error"))
    shown = F.filter(F.transform("slides", lambda s, i: F.when(F.coalesce(s["text"], F.lit("")) != "", F.concat(F.lit("## Slide "), (i + 1).cast("string"), F.lit("\n\n"), s["text"], F.lit("\n\n")))), lambda x: x.isNotNull())
    return each.select("path", F.when(F.col("error").isNull(), F.array_join(shown, "")).alias("markdown"), "error")


def _cells(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cells) of a workbook, in the order of its sheets."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    book = zipfile.ZipFile(io.BytesIO(content))
    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    names = set(book.namelist())
    strings = [text(e) for e in ET.fromstring(book.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in names else []
    targets = {e.get("Id"): e.get("Target", "") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in (e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
        target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part not in names:
            continue
        cells: dict[tuple[int, int], str] = {}
        at = 0
        for row in (e for e in ET.fromstring(book.read(part)).iter() if local(e) == "row"):
            at = int(row.get("r", at + 1))
            column = 0
            for c in (e for e in row if local(e) == "c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) if letters else column + 1
                value = next((e.text or "" for e in c if local(e) == "v"), "")
                kind = c.get("t")
                shown = text(c) if kind == "inlineStr" else strings[int(value)] if kind == "s" and value else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
                if shown:
                    cells[at, column] = shown
        if cells:
            (top, left), (bottom, right) = (tuple(f(k[i] for k in cells) for i in (0, 1)) for f in (min, max))
            out.append((sheet.get("name", ""), [[cells.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]))
    return out


def sheets(files: DataFrame, row_cap: int | None = ingest.ROW_CAP) -> DataFrame:
    """path, markdown, error of workbooks: a table for each sheet that is not empty, of ``row_cap`` rows at most."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, error = [], None
                try:
                    for i, (name, table) in enumerate(_cells(bytes(content))):
                        rows += [(path, i, name, k, len(table), row, None) for k, row in enumerate(table[:row_cap])]
                except Exception as e:
                    rows, error = [], (str(e) or type(e).__name__)[:200]
                yield pd.DataFrame(rows or [(path, None, None, None, None, None, error)], columns=["path", "sheet_ord", "sheet", "ord", "n", "cells", "error"])

    cells = files.select("path", "content").mapInPandas(work, "path string, sheet_ord int, sheet string, ord int, n int, cells array<string>, error string")
    shown = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(T.strip(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |\n"))
    rule = F.when(F.col("ord") == 0, F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("cells")), F.lit("\n"))).otherwise("")
    lines = cells.filter("ord is not null").groupBy("path", "sheet_ord", "sheet").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(shown, rule).alias("line")))).alias("lines"), F.max("n").alias("n"))
    cut = F.when(F.col("n") > row_cap, f"\n_(truncated at {row_cap} rows)_\n").otherwise("") if row_cap is not None else F.lit("")
    table = F.concat(F.lit("## "), "sheet", F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ""), cut, F.lit("\n"))
    books = lines.select("path", "sheet_ord", table.alias("table")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_ord", "table"))), lambda x: x["table"]), "").alias("markdown"))
    failed = cells.groupBy("path").agg(F.max("error").alias("error"))
    return failed.join(books, "path", "left").select("path", F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))).alias("markdown"), "error")


def media(files: DataFrame) -> DataFrame:
    """path, n, ext, bytes, origin of the images in office files (path, ext, content), numbered by name."""
    kinds = "|".join(ingest.IMAGE_FORMATS)
    found = archives.members(files, rf"(?:word|ppt|xl)/media/.*\.(?i:{kinds})").join(files.select("path", F.lower("ext").alias("of")), "path")
    where = F.coalesce(*(F.when(F.col("of") == k, v) for k, v in MEDIA.items()))
    images = F.array_sort(F.collect_list(F.struct(F.col("member").alias("origin"), "bytes")))
    each = found.filter(F.startswith("member", where)).groupBy("path").agg(images.alias("images")).select("path", F.posexplode("images").alias("i", "x"))
    return each.filter("x.bytes is not null").select("path", (F.col("i") + 1).alias("n"), F.lower(T.path_extension(F.col("x.origin"))).alias("ext"), "x.bytes", "x.origin")


class _Markdown(html.parser.HTMLParser):
    """Headings, paragraphs, emphasis, links, images, lists, quotes, code and tables.

    What stands in HIDDEN elements is held apart until they end, and comes out after all if one of them never does. The
    head needs no element of its own here: apart from HIDDEN ones, nothing in it has text.
    """

    HIDDEN = {"script", "style", "template", "title"}
    BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "ul", "ol", "table", "blockquote", "pre", "figure"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hiding: list[tuple[str, int]] = []  # open hidden elements, and how much was held when they began
        self.held: list[str] = []
        self.verbatim = 0
        self.lists: list[int | None] = []
        self.links: list[str] = []
        self.row: list[str] | None = None
        self.headed = False

    def put(self, text: str) -> None:
        (self.held if self.hiding else self.out).append(text)

    def close(self) -> None:
        if self.cdata_elem:  # a script or style that never ends
            self.handle_data(self.rawdata)
            self.rawdata = ""
        super().close()
        self.out += self.held

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in self.HIDDEN:
            self.hiding.append((tag, len(self.held)))
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCKS:
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
            self.verbatim += tag == "pre"
            self.headed = self.headed and tag != "table"
            self.put("\n\n" + {"blockquote": "> ", "pre": "```\n"}.get(tag, ""))
        elif tag == "li":
            depth = "  " * max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self.put(f"\n{depth}" + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "- "))
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag in ("b", "strong", "i", "em", "code") and not self.verbatim:
            self.put({"b": "**", "strong": "**", "code": "`"}.get(tag, "*"))
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.put("[")
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(tag)
            self.put("| " if len(self.row) == 1 else " | ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            while any(tag == open_tag for open_tag, _ in self.hiding):
                open_tag, began = self.hiding.pop()
                del self.held[began:]
                if open_tag == tag:
                    break
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n")
        elif tag in self.BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.put("\n```\n\n" if tag == "pre" else "\n\n")
            self.verbatim = max(0, self.verbatim - (tag == "pre"))
        elif tag in ("b", "strong", "i", "em", "code") and not self.verbatim:
            self.put({"b": "**", "strong": "**", "code": "`"}.get(tag, "*"))
        elif tag == "a" and self.links:
            self.put(f"]({self.links.pop()})")
        elif tag == "tr" and self.row is not None:
            self.put(" |\n" + ("" if self.headed else "|" + " --- |" * len(self.row) + "\n"))
            self.row, self.headed = None, True

    def handle_data(self, data: str) -> None:
        if self.verbatim:
            self.put(data)
        elif data.strip() or not self.out or not self.out[-1].endswith("\n"):
            text = re.sub(r"\s+", " ", data)
            self.put(text.replace("|", "\\|") if self.row is not None else text)


def _page(text: str | None) -> str | None:
    if text is None:
        return None
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(parser.out))).strip()


@F.pandas_udf(StringType())
def html_markdown(text: pd.Series) -> pd.Series:
    """Web pages with their structure: headings, links, lists, tables."""
    return text.map(_page)


def convert(sources: DataFrame, marker: str | None = ingest.MARKER, row_cap: int | None = ingest.ROW_CAP, char_cap: int | None = ingest.CHAR_CAP) -> DataFrame:
    """``ingest.convert`` for path, ext, filename, content, with office files decoded and web pages in their structure."""
    of = lambda *kinds: sources.filter(F.lower("ext").isin(*kinds)).select("path", "content")
    read = documents(of("docx")).unionByName(slides(of("pptx"))).unionByName(sheets(of("xlsx", "xls", "ods"), row_cap))
    read = read.select(F.col("path").alias("_path"), F.col("markdown").alias("_read"), F.col("error").alias("_error"))
    base = ingest.convert(sources, None, row_cap, char_cap).join(read, F.col("path") == F.col("_path"), "left")
    ext, is_page = F.lower("ext"), F.lower("ext").isin("html", "htm")
    note = F.concat(F.lit("> "), F.when(ext.isin("docx", "pptx"), ext).otherwise("spreadsheet"), F.lit(" conversion failed: "), "_error", F.lit("\n"))
    office = ext.isin(OFFICE)
    page = html_markdown(F.when(is_page, ingest.decoded(F.col("content"))))
    out = base.withColumn("markdown", F.when(office & F.col("_error").isNull(), F.col("_read")).when(office, note).when(is_page, page).otherwise(F.col("markdown")))
    out = out.withColumn("needs_llm", F.when(office, F.col("_error").isNotNull()).otherwise(F.col("needs_llm"))).withColumn("format", F.when(ext.isin("xlsx", "xls", "ods"), "spreadsheet").otherwise(F.col("format")))
    out = out.drop("_path", "_read", "_error")
    return out if marker is None else ingest.with_banner(out, marker)


def with_figures(sources: DataFrame, marker: str = ingest.MARKER) -> DataFrame:
    """Converted sources (without banner) with figures (array of file, provisional, described, origin), found (array of ext,
    bytes, origin, in the same order), references to them in the markdown, and the banner where it is due: images inside a
    web page or Markdown text, and the media of office files."""
    inside = F.lower("ext").isin("html", "htm", "md", "markdown")
    apart = ingest.figures_apart(sources.withColumn("_whole", F.col("markdown")).withColumn("body", F.when(inside, F.col("markdown")).otherwise("")))
    each = media(sources.filter(F.lower("ext").isin(OFFICE))).groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list(F.struct("n", "ext", "bytes", "origin"))).alias("_media"))
    kept = F.transform("_media", lambda x: F.struct(x["ext"].alias("ext"), x["bytes"].alias("bytes"), x["origin"].alias("origin")))
    joined = apart.join(each, F.col("path") == F.col("_path"), "left").withColumn("found", F.coalesce(kept, F.col("found"))).withColumn("body", F.when(inside, F.col("body")).otherwise(F.col("_whole")))
    out = ingest.figures_written(joined).withColumn("markdown", F.col("body"))
    return ingest.with_banner(out.drop("_path", "_media", "_whole", "body"), marker)
