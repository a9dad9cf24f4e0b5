"""Scalar text functions over columns, built from Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scholarly publishers, preprint hosts, gray-literature hosts, markers of scholarly text.
PUBLISHERS = [
    "elsevier", "springer", "wiley", "ieee", "plos", "mdpi", "oxford university press", "cambridge university press", "nature", "the lancet", "lancet",
    "cell press", "american chemical society", "frontiers", "bmj", "american medical association", "massachusetts medical society", "taylor & francis", "sage",
    "wolters kluwer", "karger", "thieme", "american physical society", "acm", "national academy of sciences", "pnas", "royal society", "emerald", "de gruyter",
    "annual reviews",
]
PREPRINT_HOSTS = ["arxiv.org", "biorxiv.org", "medrxiv.org", "chemrxiv.org", "ssrn.com", "preprints.org", "researchsquare.com", "osf.io", "psyarxiv.com"]
GRAY_HOSTS = ["who.int", "clinicaltrials.gov", "europa.eu", "nih.gov", "cdc.gov", "fda.gov"]
PREPRINT_WORDS = ["biorxiv", "medrxiv", "arxiv", "chemrxiv", "preprint server"]
JOURNAL_WORDS = ["received:", "accepted:", "peer-reviewed", "corresponding author", "doi:", "journal of", "et al.", "abstract"]

#: What counts as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def file_order(path: Column) -> Column:
    """Folders before what follows them: component by component, as one comparable string."""
    return F.replace(path, F.lit("/"), F.lit("\x01"))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def slug(text: Column) -> Column:
    """ASCII letters and digits lowered, other runs one dash, cut where the dashless ends reach 40 characters."""
    dashed = F.ltrim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-")), F.lit("-"))
    cut = F.when(F.substring(dashed, 40, 1) == "-", F.substring(dashed, 1, 41)).otherwise(F.substring(dashed, 1, 40))
    return F.rtrim(cut, F.lit("-"))


def commit_slug(text: Column) -> Column:
    """The slug of the first 40 characters."""
    return slug(F.left(text, F.lit(40)))


def kb_id(name: Column) -> Column:
    """An id from a folder's name: letters and digits lowered, other runs one dash, ends stripped, or ``base``."""
    return F.coalesce(F.nullif(F.btrim(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "-")), F.lit("-")), F.lit("")), F.lit("base"))


def junk(path: Column) -> Column:
    """Whether a member or file is left by an operating system."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    return path.contains("__MACOSX") | (base == ".DS_Store") | base.startswith("._")


def today() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")


def source_id(title: Column, content: Column) -> Column:
    """Slug of the title (or ``source``) and six hex digits of the content's SHA-256."""
    s = slug(title)
    return F.concat_ws("-", F.when(s == "", "source").otherwise(s), F.left(F.sha2(content, 256), F.lit(6)))


def machine_generated(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit("-"), F.lit("")).rlike("^[0-9a-fA-F]{12,}$")


def title_from(markdown: Column, filename: Column, explicit: Column) -> Column:
    """The given title, else the first heading, else the first line of eight bytes, else the cleaned file name; never a hash."""
    lines = F.transform(F.split(markdown, "\r?\n"), lambda x: F.trim(x))
    headings = F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.trim(F.ltrim(x, F.lit("#"))))
    heading = F.get(F.filter(headings, lambda h: (h != "") & ~machine_generated(h)), 0)
    line = F.left(F.get(F.filter(lines, lambda x: (F.octet_length(x) >= 8) & ~machine_generated(x)), 0), F.lit(80))
    stem = F.trim(F.translate(F.regexp_replace(F.regexp_extract(filename, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), "_-", "  "))
    usable = lambda c: F.when((F.trim(c) != "") & ~machine_generated(c), F.trim(c))
    return F.coalesce(usable(explicit), heading, line, usable(stem), F.lit("Untitled source"))


def url_host(url: Column) -> Column:
    """Everything between the scheme and the next slash, lowered; null for anything but http(s)."""
    return F.when(url.rlike("^https?://"), F.lower(F.regexp_extract(url, "^https?://([^/]*)", 1)))


def host_in(host: Column, hosts: list[str]) -> Column:
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def _capture(text: Column, *options: tuple[str, int]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p, g in options))


# The patterns of identifiers below, and the prefix of preprints' DOIs.
def preprint_doi(c: Column) -> Column:
    return c.startswith("10.1101/")


def doi(text: Column) -> Column:
    found = F.lower(F.nullif(F.regexp_extract(text, r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:a-z0-9]+)\b", 1), F.lit("")))
    return F.regexp_replace(found, r"\.$", "")


def arxiv(text: Column) -> Column:
    both = r"(?i)arxiv:([0-9]{4}\.[0-9]{4,5})|arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})"
    return _capture(text, (both, 1), (both, 2))


def pmid(text: Column) -> Column:
    both = r"(?i)\bpmid[:\s]\s*([0-9]{6,9})\b|pubmed\.ncbi\.nlm\.nih\.gov/([0-9]{6,9})"
    return _capture(text, (both, 1), (both, 2))


def pmcid(text: Column) -> Column:
    return F.concat(F.lit("PMC"), _capture(text, (r"(?i)\bPMC([0-9]{5,9})\b", 1)))


def isbn(text: Column) -> Column:
    return _capture(text, (r"(?i)\bISBN(?:-1[03])?:?\s*(97[89][- ]?(?:[0-9][- ]?){9}[0-9]|(?:[0-9][- ]?){9}[0-9X])\b", 1))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def allowlisted(publisher: Column) -> Column:
    return contains_any(F.lower(publisher), PUBLISHERS)


def strip_markup(text: Column) -> Column:
    """Paragraph ends to blank lines, tags away (an unclosed one takes the rest, a stray > goes), five entities decoded in turn."""
    out = F.regexp_replace(F.regexp_replace(text, r"<[^>]*(?:>|\z)", ""), ">", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def path_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1)


def url_extension(url: Column, content_type: Column, head: Column) -> Column:
    """From the path if 1 to 5 characters, else from the content type, else from the first bytes; html by default."""
    ext = path_extension(F.regexp_extract(url, r"^([^?#]*)", 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.octet_length(ext).between(1, 5), ext)
        .when(kind.contains("pdf"), "pdf")
        .when(kind.contains("html"), "html")
        .when(kind.contains("json"), "json")
        .when(kind.contains("csv"), "csv")
        .when(kind.contains("plain"), "txt")
        .when(head.startswith("%PDF"), "pdf")
        .otherwise("html")
    )


def url_filename(url: Column, ext: Column) -> Column:
    parts = F.filter(F.split(F.regexp_extract(url, r"^([^?#]*)", 1), "/"), lambda p: p != "")
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("source"))
    return F.when(last.contains("."), last).otherwise(F.concat_ws(".", last, ext))


#: What stands between quotes: anything but a quote, and doubled quotes. Possessive, so that no cell is too long for it.
QUOTED = r'"(?:[^"]++|"")*+(?:"|\z)'


def split_delimited(line: Column, delimiter: str = ",") -> Column:
    """Cells of one line, trimmed, pipes escaped: a delimiter inside an open quote does not part cells; doubled quotes
    inside quotes stand for one; a quote may open anywhere, and one that never closes takes the rest."""
    d = "\\" + delimiter if delimiter in r".|*+?^$()[]{}\\" else delimiter
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}((?:[^{d}"]++|{QUOTED})*+)'), F.lit(1))
    inner = lambda c: F.replace(F.regexp_replace(c, r'"((?:[^"]++|"")*+)(?:"|\z)', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.replace(strip(inner(c)), F.lit("|"), F.lit("\\|")))


def kb_id_valid(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.char_length(c) <= 64)


def curie_like(c: Column) -> Column:
    return c.contains(":") & ~c.contains(" ") & ~c.contains("(")


def measurement(c: Column) -> Column:
    return F.trim(c).rlike(r"^[0-9]+\.?[0-9]*\s*(?:%|[A-Za-z]{1,3})?$")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value made once, however often it is used, be it for each item of an array."""
    return F.get(F.transform(F.array(value), then), 0)


def coverage(extracted: Column, rendered: Column) -> Column:
    """Share of the distinct words (five ASCII letters or more) of one text that occur in the other; null below 50 words.

    The other text's runs of letters are set against the words at once; only words that are none of them are looked for
    inside its longer runs, each of them once.
    """
    long_ones = lambda words, least=5: F.filter(words, lambda w: F.length(w) >= least)
    words = F.array_distinct(long_ones(F.transform(F.split(extracted, "[^A-Za-z]+"), lambda w: F.lower(w))))
    runs = F.array_distinct(long_ones(F.split(F.lower(F.coalesce(rendered, F.lit(""))), "[^a-z]+")))
    inside = lambda text, rest: F.size(F.filter(rest, lambda w: text.contains(w)))
    missed = lambda rest, r: F.size(rest) - bound(F.array_join(long_ones(r, 6), " "), lambda text: inside(text, rest))
    share = lambda w: bound(runs, lambda r: bound(F.array_except(w, r), lambda rest: (F.size(w) - missed(rest, r)) / F.size(w)))
    return bound(words, lambda w: F.when(F.size(w) >= 50, share(w)))


def snippet(text: Column, terms: list[str]) -> Column:
    """160 characters from 40 before the first query term, white space collapsed, cuts marked."""
    low = F.lower(text)
    hits = [F.when(F.locate(t, low) > 0, F.locate(t, low)) for t in terms]
    first = F.coalesce(F.least(*hits) if len(hits) > 1 else hits[0], F.lit(1))
    start = F.greatest(first - 40, F.lit(1))
    part = F.regexp_replace(F.trim(F.substr(text, start, F.lit(160))), r"\s+", " ")
    return F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(start + 159 < F.char_length(text), "…").otherwise(""))
