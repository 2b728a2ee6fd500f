"""Files of many formats into documents (doc_id, source, items), by a registry of readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import basename, suffix
from weftline.operators.chunking import join_spaced

Item = tuple[str, int | None, str]
READERS: dict[str, Callable[[bytes], list[Item]]] = {}


def reader(*suffixes: str):
    """Registers how files of these suffixes are read; others are read as plain text."""

    def put(f):
        for s in suffixes:
            READERS[s] = f
        return f

    return put


@reader(".txt", ".md")
def read_text(data: bytes) -> list[Item]:
    return [(data.decode("utf-8", "replace"), None, "prose")]


class _Text(HTMLParser):
    #: Elements whose text is no content, and those that start a new line.
    SKIPPED = {"script", "style", "nav", "footer"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.SKIPPED

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_to_text(html: str | None) -> str:
    """Visible text, a line for each stretch of it; scripts, styles, navigation and footers are left out."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


@reader(".html", ".htm")
def read_html(data: bytes) -> list[Item]:
    return [(html_to_text(data.decode("utf-8", "replace")), None, "prose")]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@reader(".docx")
def read_docx(data: bytes) -> list[Item]:
    """Paragraphs, headings with # signs by their level, then the tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines, tables = [], []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            text = text_of(e)
            if m := re.match(r"Heading\s*(\d)", name):
                text = f"{'#' * min(int(m.group(1)), 6)} {text}"
            elif name == "Title":
                text = f"# {text}"
            lines.append(text)
        elif e.tag == f"{_W}tbl":
            tables.append([[text_of(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")])
    items: list[Item] = [("\n".join(lines), None, "prose")]
    for rows in tables:
        if md := table_lines(rows):
            items.append((md, None, "table"))
    return items


def table_lines(rows: list[list[str | None]]) -> str:
    cells = ([(c or "").strip() for c in r] for r in rows)
    return "\n".join(" | ".join(r) for r in cells if any(r))


@reader(".pdf")
def read_pdf(data: bytes) -> list[Item]:
    """Page by page, tables before the page's prose; needs the optional pdfplumber."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfplumber, or another reader registered for .pdf") from e
    items: list[Item] = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            found = page.find_tables()
            for t in found:
                if md := table_lines(t.extract()):
                    items.append((md, n, "table"))
            for t in found:
                page = page.outside_bbox(t.bbox)
            items.append((join_spaced(page.extract_text() or ""), n, "prose"))
    return items


def read_files(spark: SparkSession, *paths: str, ignore_missing: bool = False, glob: str | None = None) -> DataFrame:
    """Rows (doc_id, source, items): doc_id is the file's stem. Files are read by the executors, whole."""
    r = spark.read.format("binaryFile").option("ignoreMissingFiles", str(ignore_missing).lower()).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(list(paths)).select("path", "content", suffix(F.col("path")).alias("suffix"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = [[{"text": t, "page": p, "kind": k} for t, p, k in READERS.get(s, read_text)(bytes(c))] for s, c in zip(b["suffix"], b["content"], strict=True)]
            yield pd.DataFrame({"source": b["path"], "items": items})

    read = files.mapInPandas(run, "source string, items array<struct<text:string,page:int,kind:string>>")
    return read.select(F.regexp_replace(basename(F.col("source")), r"\.[^.]*$", "").alias("doc_id"), "source", "items")


def documents_from_table(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A table of texts as documents of one item each."""
    item = F.struct(F.coalesce(text_col, F.lit("")).alias("text"), F.lit(None).cast("int").alias("page"), F.lit("prose").alias("kind"))
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source"), F.array(item).alias("items"))


def html_text(html: Column) -> Column:
    """html_to_text for a column."""

    @F.pandas_udf("string")
    def visible(values: pd.Series) -> pd.Series:
        return values.map(html_to_text)

    return visible(html)
