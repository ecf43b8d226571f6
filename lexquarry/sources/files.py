"""Files to elements: scan, content hash, dispatch by suffix, page slices, and pluggable extractors."""

from __future__ import annotations

import html
import http.client
import io
import json
import re
import time
import urllib.parse
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators.incremental import unseen
from lexquarry.ship import ship

# Suffixes that are read, their MIME types, and the parameters of the extraction service.
MIME = {
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".ppt": "application/vnd.ms-powerpoint", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12", ".ppsx": "application/vnd.openxmlformats-officedocument.presentationml.slideshow",
    ".potx": "application/vnd.openxmlformats-officedocument.presentationml.template",
}
SLIDES = (".pptx", ".pptm", ".ppsx", ".potx", ".ppt")
PAGES_PER_SLICE = 60
UPLOAD = {"connect": 15.0, "floor": 120.0, "bytes_per_second": 256 * 1024, "times": 3.0, "pad": 45.0, "cap": 1800.0, "unknown": 300.0}
PDF_FIELDS = {"strategy": "hi_res", "coordinates": "true", "include_page_breaks": "true", "pdf_infer_table_structure": "true", "languages": "vie"}
FIELDS = {"strategy": "auto", "include_page_breaks": "true", "languages": "vie"}
RETRIED = (408, 429)
"""Answers of the service, besides 5xx, that are worth another attempt."""
PICTURE = "[HÌNH] Ảnh/biểu đồ trên slide"

ELEMENT = "element_id string, element_type string, text string, page_number int, slide_number int, text_as_html string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def mime(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit("application/octet-stream"))


def strategy(path: Column) -> Column:
    """PDFs are read with layout analysis, others as the service sees fit."""
    return F.when(suffix(path) == ".pdf", "hi_res").otherwise("auto")


def upload_timeout(n_bytes: Column) -> Column:
    """Seconds to wait for the answer to an upload of that size."""
    u = UPLOAD
    known = F.greatest(F.lit(u["floor"]), n_bytes / u["bytes_per_second"] * u["times"] + u["pad"])
    return F.when(n_bytes > 0, F.least(F.lit(u["cap"]), known)).otherwise(F.greatest(F.lit(u["floor"]), F.lit(u["unknown"])))


def source_columns(path: Column) -> dict[str, Column]:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return {"source_path": path, "source_name": name, "source_ext": suffix(path), "doc_id": F.regexp_replace(name, r"\.[^.]*$", "")}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, source_sha1, content and source columns of all files of a known kind, in any subfolder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(suffix(F.col("path")).isin(*MIME))
    return files.select("path", F.sha1("content").alias("source_sha1"), "length", "content", *(c.alias(n) for n, c in source_columns(F.col("path")).items()))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't known yet; of equal files the first path."""
    first = files.groupBy("source_sha1").agg(F.min("path").alias("path"))
    return unseen(files.join(first, ["source_sha1", "path"], "left_semi"), known)


def slices(pages: Column, most: int = PAGES_PER_SLICE) -> Column:
    """(first, last) page of each slice, from 0; one of unknown length is a single slice that ends at -1."""
    cut = F.transform(F.sequence(F.lit(0), pages - 1, F.lit(most)), lambda a: F.struct(a.alias("first"), F.least(a + most, pages).cast("int").alias("last")))
    return F.when(pages > 0, cut).otherwise(F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last"))))


class Extractor(Protocol):
    """Reads one file, or some of its pages, to elements: dicts with the fields of ELEMENT."""

    def pages(self, content: bytes, suffix: str) -> int: ...

    def extract(self, content: bytes, suffix: str, first: int, last: int) -> Iterator[dict]: ...


class PlainText:
    """For text in UTF-8, whatever its suffix: paragraphs, form feeds as page ends, lines in capitals as titles."""

    def pages(self, content: bytes, suffix: str) -> int:
        return content.count(b"\f") + 1

    def extract(self, content: bytes, suffix: str, first: int, last: int) -> Iterator[dict]:
        for page, text in enumerate(content.decode("utf-8", "replace").split("\f")[first : None if last < 0 else last], 1):
            for k, part in enumerate(p.strip() for p in text.split("\n\n")):
                if part:
                    yield {"element_id": f"{page}-{k}", "element_type": "Title" if part.isupper() else "NarrativeText", "text": part, "page_number": page, "slide_number": page if suffix in SLIDES else None, "text_as_html": None}


def element(n: str, kind: str, text: str, page: int | None, slide: int | None = None, html: str | None = None) -> dict:
    return {"element_id": n, "element_type": kind, "text": text, "page_number": page, "slide_number": slide, "text_as_html": html}


def _local_name(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _said(node: ElementTree.Element) -> str:
    """The runs of text under a node of an Office document, a line per paragraph."""
    return "\n".join("".join(t.text or "" for t in p.iter() if _local_name(t) == "t") for p in node.iter() if _local_name(p) == "p").strip()


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [n for n in node if _local_name(n) == name]


def markdown(rows: list[list[str]]) -> str:
    """functions.tables.grid for Python."""
    lines = ["| " + " | ".join(" ".join(c.split("\n")).strip() for c in r) + " |" for r in rows]
    return "\n".join(lines[:1] + ["|" + " --- |" * (lines[0].count("|") - 1)] + lines[1:]) if lines else ""


class Slides:
    """PowerPoint files by their own XML: titles, text, tables and pictures, a page per slide."""

    def _slides(self, content: bytes) -> list[bytes]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
            return [z.read(n) for _, n in sorted(names)]

    def pages(self, content: bytes, suffix: str) -> int:
        return len(self._slides(content))

    def extract(self, content: bytes, suffix: str, first: int, last: int) -> Iterator[dict]:
        # slides keep their number in the file, whatever the slice
        for slide, xml in enumerate(self._slides(content)[first : None if last < 0 else last], 1):
            at, title = first + slide, ""
            shapes = [n for n in ElementTree.fromstring(xml).iter() if _local_name(n) in ("sp", "graphicFrame", "pic")]
            heads = [s for s in shapes if any(_local_name(n) == "ph" and n.get("type") in ("title", "ctrTitle") for n in s.iter())]
            if heads and (title := _said(heads[0])):
                yield element(f"slide{at}-title", "Title", title, slide, at)
            for k, shape in enumerate(shapes, 1):
                kind = _local_name(shape)
                if kind == "sp" and (text := _said(shape)) and text != title:
                    yield element(f"slide{at}-shape{k}-p", "NarrativeText", text, slide, at)
                for table in (n for n in shape.iter() if _local_name(n) == "tbl"):
                    if md := markdown([[_said(c) for c in _children(r, "tc")] for r in _children(table, "tr")]):
                        yield element(f"slide{at}-shape{k}-tbl", "Table", f"[BẢNG]\n{md}", slide, at)
                if kind == "pic":
                    yield element(f"slide{at}-shape{k}-img", "Image", PICTURE, slide, at)


class Word:
    """Word files by their own XML: paragraphs, headings as titles, and tables; they have no pages."""

    def pages(self, content: bytes, suffix: str) -> int:
        return 0

    def extract(self, content: bytes, suffix: str, first: int, last: int) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = next(n for n in ElementTree.fromstring(z.read("word/document.xml")) if _local_name(n) == "body")
        for k, node in enumerate(body):
            if _local_name(node) == "p" and (text := _said_in(node)):
                style = next((v for n in node.iter() if _local_name(n) == "pStyle" for a, v in n.attrib.items() if a.endswith("val")), "")
                yield element(f"p{k}", "Title" if style.lower().startswith(("heading", "title")) else "NarrativeText", text, None)
            elif _local_name(node) == "tbl":
                rows = [[_said(c) for c in _children(r, "tc")] for r in _children(node, "tr")]
                cells = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in rows)
                yield element(f"t{k}", "Table", markdown(rows), None, None, f"<table>{cells}</table>")


def _said_in(paragraph: ElementTree.Element) -> str:
    return "".join("\n" if _local_name(t) == "br" else t.text or "" for t in paragraph.iter() if _local_name(t) in ("t", "br")).strip()


class Unreadable(ValueError):
    """No extractor reads this kind of file, or its content isn't of that kind."""


class BySuffix:
    """Extractors by suffix; a file that none of them reads is an error, never noise."""

    def __init__(self, by: dict[str, Extractor]):
        self.by = by

    def _of(self, content: bytes, suffix: str) -> Extractor:
        if suffix not in self.by:
            raise Unreadable(f"no extractor for {suffix or 'files without a suffix'}; have {', '.join(sorted(self.by))}")
        if suffix in SIGNED and not content.startswith(SIGNED[suffix]):
            raise Unreadable(f"not a {suffix} file: it begins with {content[:8]!r}")
        return self.by[suffix]

    def pages(self, content: bytes, suffix: str) -> int:
        return self._of(content, suffix).pages(content, suffix)

    def extract(self, content: bytes, suffix: str, first: int, last: int) -> Iterator[dict]:
        return self._of(content, suffix).extract(content, suffix, first, last)


SIGNED = {".docx": b"PK", ".pptx": b"PK", ".pptm": b"PK", ".ppsx": b"PK", ".potx": b"PK", ".pdf": b"%PDF"}
OFFLINE = BySuffix({".docx": Word(), ".pptx": Slides(), ".pptm": Slides(), ".ppsx": Slides(), ".potx": Slides()})
"""What can be read without a service. PDFs, .doc and .ppt need one: see `Remote` and `with_remote`."""


class Remote:
    """An extraction service over HTTP: a multipart upload per file, JSON elements as the answer.

    Connections are one per worker and are kept open; 5xx, 408, 429 and broken connections are tried again after 2, 4, 8 and
    then 10 seconds. The key is sent as a header and never logged.
    """

    def __init__(self, url: str, key: str, header: str = "api-key", attempts: int = 4, sleep: Callable[[float], None] = time.sleep):
        self.url, self.key, self.header, self.attempts, self.sleep = url, key, header, attempts, sleep
        if not key:
            raise ValueError("the extraction service needs a key")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def pages(self, content: bytes, suffix: str) -> int:
        return 0  # the service reads whole files

    def timeout(self, n_bytes: int) -> float:
        u = UPLOAD
        return min(u["cap"], max(u["floor"], n_bytes / u["bytes_per_second"] * u["times"] + u["pad"])) if n_bytes else max(u["floor"], u["unknown"])

    def body(self, content: bytes, suffix: str, mark: str) -> bytes:
        fields = PDF_FIELDS if suffix == ".pdf" else FIELDS
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
        head = f'--{mark}\r\nContent-Disposition: form-data; name="files"; filename="file{suffix}"\r\nContent-Type: {MIME.get(suffix, "application/octet-stream")}\r\n\r\n'
        return b"".join([*parts, head.encode(), content, f"\r\n--{mark}--\r\n".encode()])

    def _connection(self, timeout: float) -> http.client.HTTPConnection:
        at = urllib.parse.urlsplit(self.url)
        if getattr(self, "_open", None) is None:
            self._open = (http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection)(at.netloc, timeout=UPLOAD["connect"])
            self._open.connect()
        self._open.sock.settimeout(timeout)
        return self._open

    def ask(self, content: bytes, suffix: str) -> list[dict]:
        mark, why = uuid.uuid4().hex, None
        path = urllib.parse.urlsplit(self.url).path or "/"
        headers = {"Accept": "application/json", self.header: self.key, "Content-Type": f"multipart/form-data; boundary={mark}"}
        for attempt in range(1, self.attempts + 1):
            try:
                connection = self._connection(self.timeout(len(content)))
                connection.request("POST", path, self.body(content, suffix, mark), headers)
                answer = connection.getresponse()
                said = answer.read()
            except (OSError, http.client.HTTPException) as broken:
                why, self._open = repr(broken), None
            else:
                if answer.status in (200, 201):
                    return json.loads(said)
                why = f"HTTP {answer.status}: {said[:300]!r}"
                if answer.status < 500 and answer.status not in RETRIED:
                    raise Unreadable(why)
            if attempt < self.attempts:
                self.sleep(min(2**attempt, 10))
        raise OSError(f"no answer after {self.attempts} attempts: {why}")

    def extract(self, content: bytes, suffix: str, first: int, last: int) -> Iterator[dict]:
        for k, e in enumerate(self.ask(content, suffix)):
            meta = e.get("metadata") or {}
            yield element(str(e.get("element_id") or k), e.get("type") or "", e.get("text") or "", meta.get("page_number"), meta.get("slide_number"), meta.get("text_as_html"))


def with_remote(remote: Remote) -> BySuffix:
    """Slides are read here, everything else by the service."""
    return BySuffix({suffix: remote for suffix in MIME} | {k: v for k, v in OFFLINE.by.items() if k in SLIDES})


def extracted(files: DataFrame, extractor: Extractor, most: int = PAGES_PER_SLICE, attempts: int = 4) -> DataFrame:
    """Elements of each file, with absolute pages. A file fails as a whole, after some attempts, or not at all."""
    ship(files.sparkSession)
    keep = ["source_sha1", "source_path", "source_name", "source_ext", "doc_id"]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = extractor.pages(row["content"], row["source_ext"])
                found = []
                for first in range(0, max(n, 1), most):
                    last = min(first + most, n) if n else -1
                    for attempt in range(attempts):
                        try:
                            got = list(extractor.extract(row["content"], row["source_ext"], first, last))
                            break
                        except (OSError, TimeoutError):
                            if attempt == attempts - 1:
                                raise
                    found += [e | {"page_number": None if e["page_number"] is None else e["page_number"] + first} for e in got]
                if found:
                    names = [x.split()[0] for x in ELEMENT.split(", ")]
                    own = {c: [row[c]] * len(found) for c in keep} | {"ord": list(range(len(found)))} | {c: [e[c] for e in found] for c in names}
                    kinds = {"ord": pa.int64(), "page_number": pa.int32(), "slide_number": pa.int32()}
                    yield pa.record_batch({c: pa.array(v, kinds.get(c, pa.string())) for c, v in own.items()})

    schema = ", ".join(f"{c} string" for c in keep) + f", ord long, {ELEMENT}"
    return files.select(*keep, "content").mapInArrow(read, schema)
