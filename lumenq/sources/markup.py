"""TEI and HTML to chunks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.operators.chunking import MERGE_CHARS, merge_rows, split_text
from lumenq.operators.postings import lots

NS = "{http://www.tei-c.org/ns/1.0}"
CHUNKS = "chunk_id string, ordinal int, section string, text string, chunk_type string, index_text string, caption string, table_columns array<string>, table_rows array<array<string>>"

ARROW_CHUNKS = [("chunk_id", pa.string()), ("ordinal", pa.int32()), *[(c, pa.string()) for c in ("section", "text", "chunk_type", "index_text", "caption")], ("table_columns", pa.list_(pa.string())), ("table_rows", pa.list_(pa.list_(pa.string())))]
#: Bytes of documents that are parsed at once.
LOT = 1 << 21


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def table_of(figure: ET.Element) -> dict | None:
    """A table figure's Markdown, columns, rows and index text; None without a row that holds anything."""
    title = figure.find(NS + "head")
    shown = _text(title if title is not None else figure.find(NS + "figDesc"))
    grid = [(i, r.findall(NS + "cell")) for i, r in enumerate(figure.iterfind(f"{NS}table/{NS}row"))]
    filled = [(i, cells, [_text(c) for c in cells]) for i, cells in grid]
    filled = [x for x in filled if any(x[2])]
    if not filled:
        return None
    lines, columns, rows = [], None, []
    for i, cells, values in filled:
        lines.append("| " + " | ".join(v or " " for v in values) + " |")
        if columns is None and (i == 0 or any(c.get("role") == "head" for c in cells)):
            columns = values
            lines.append("|" + "---|" * max(1, len(values)))
        else:
            rows.append(values)
    if columns is None:
        columns = [f"Column {k + 1}" for k in range(max(map(len, rows)))]
    caption = _text(title) if title is not None else "Table"
    cells = dict.fromkeys(v for _, _, values in filled for v in values if v)
    return {"text": "\n".join([*([shown] if shown else []), *lines]), "caption": caption, "table_columns": columns, "table_rows": rows, "index_text": " ".join([*([caption] if caption else []), *cells])}


def body_chunks(parent: ET.Element, section: str = "Unknown") -> Iterator[dict]:
    """Paragraphs, then table figures, of each division, then its inner divisions; a division without a head has its parent's."""
    for div in parent.findall(NS + "div"):
        head = div.find(NS + "head")
        name = section if head is None else _text(head)
        for p in div.findall(NS + "p"):
            if _text(p):
                yield {"section": name, "text": _text(p), "chunk_type": "paragraph"}
        for figure in div.findall(NS + "figure"):
            made = table_of(figure) if figure.get("type") == "table" else None
            if made:
                yield {"section": name, "chunk_type": "table", **made}
        yield from body_chunks(div, name)


def tei_document(xml: str) -> tuple[dict, list[dict]]:
    """Title, abstract (1000 characters) and chunks of a TEI document, short ones merged and long ones split."""
    root = ET.fromstring(xml)
    meta = {"title": _text(root.find(f".//{NS}titleStmt/{NS}title")), "abstract": _text(root.find(f".//{NS}abstract"))[:1000]}
    body = root.find(f".//{NS}body")
    parts = [c | {"text": t} for c in merge_rows(list(body_chunks(body)) if body is not None else [], MERGE_CHARS) for t in split_text(c["text"])]
    return meta, [{"chunk_id": f"chunk_{i:04d}", "ordinal": i, **c} for i, c in enumerate(parts)]


class _Page(HTMLParser):
    """Headings, paragraphs and list items of a page, unclosed ones too; scripts, styles, navigation and adverts are left out."""

    SKIP = {"nav", "script", "style", "footer", "aside", "noscript"}
    BLOCKS = {"p", "li", "div", "article", "section", "br", "ul", "ol", "table", "tr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.section, self.out, self.held, self.skip, self.head, self.ads = "Unknown", [], [], 0, None, []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append({"section": self.section, "text": text, "chunk_type": "paragraph"})

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            self.ads.append("ad" in (dict(attrs).get("class") or "").split())
            self.skip += self.ads[-1]
        if tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.head = []
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.BLOCKS and self.head is None and not self.skip:
            self.flush()
        if tag == "div" and self.ads:
            self.skip -= self.ads.pop()
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) and self.head is not None:
            self.section = " ".join("".join(self.head).split()) or self.section
            self.head = None

    def handle_data(self, data):
        if not self.skip:
            (self.held if self.head is None else self.head).append(data)


def html_document(html: str) -> list[dict]:
    page = _Page()
    body = re.sub(r"(?is)^.*?<body[^>]*>", "", html or "", count=1)
    page.feed(body)
    page.close()
    page.flush()
    return [{"chunk_id": f"chunk_{i:04d}", "ordinal": i, **c} for i, c in enumerate(page.out)]


def parse(docs: DataFrame, content: str, key: str, reader: Callable[[str], list[dict]]) -> DataFrame:
    """A row for each chunk that ``reader`` makes of each document; a document that it can't read has one row with its ``error``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, LOT):
            rows, schema = [], pa.schema([b.schema.field(key), ("error", pa.string()), *ARROW_CHUNKS])
            for k, text in zip(b.column(key).to_pylist(), b.column(content).to_pylist(), strict=True):
                try:
                    rows += [{key: k, "error": None, **c} for c in reader(text)]
                except (ET.ParseError, ValueError, TypeError) as e:
                    rows.append({key: k, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, content).mapInArrow(run, f"{key} {kind}, error string, {CHUNKS}")


def parse_tei(docs: DataFrame, content: str = "tei", key: str = "paper_id") -> DataFrame:
    return parse(docs, content, key, lambda x: tei_document(x)[1])


def parse_html(pages: DataFrame, content: str = "html", key: str = "page_id") -> DataFrame:
    return parse(pages, content, key, html_document)


def parse_pdf(files: DataFrame, to_tei: Callable[[bytes], str]) -> DataFrame:
    """PDF files (path, content, as Spark's binaryFile source gives them) through a parser service: ``to_tei`` maps bytes to TEI and may raise RuntimeError."""

    def read(raw: bytes) -> list[dict]:
        try:
            return tei_document(to_tei(raw))[1]
        except RuntimeError as e:
            raise ValueError(str(e)) from e

    return parse(files, "content", "path", read)


LIBRARY = f"paper_id string, path string, title string, abstract string, n_chunks int, error string, {CHUNKS}"


def parse_library(files: DataFrame, to_tei: Callable[[bytes], str], min_chars: int = 80) -> DataFrame:
    """PDF files (path, content) as rows of three kinds: a paper's title and abstract, its chunks of ``min_chars`` or more, or why it was rejected.

    A paper's id is its file's name without the ending, and stands before its chunks' ids. Whatever the service raises rejects one file and no more.
    """
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                own = {"paper_id": path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": path}
                try:
                    meta, chunks = tei_document(to_tei(raw))
                except Exception as e:  # noqa: BLE001 - the service is the caller's
                    rows.append({**own, "kind": "reject", "error": f"{type(e).__name__}: {e}"})
                    continue
                kept = [c for c in chunks if len(c.get("text") or "") >= min_chars]
                rows.append({**own, "kind": "paper", "title": meta.get("title") or "", "abstract": meta.get("abstract") or "", "n_chunks": len(kept)})
                rows += [{**own, "kind": "chunk", **c, "chunk_id": f"{own['paper_id']}_{c['chunk_id']}"} for c in kept]
            out = pd.DataFrame(rows, columns=["paper_id", "path", "title", "abstract", "n_chunks", "error", *names, "kind"])
            out = out.astype({"ordinal": "Int32", "n_chunks": "Int32"})
            yield out.astype(object).where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, f"{LIBRARY}, kind string")


def with_paper_ids(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("__"), "chunk_id"))
