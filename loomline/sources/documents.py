"""Files with inner structure as rows: HTML pages as blocks, Word documents as blocks, tables and images."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the Office Open XML format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

BLOCKS = "path string, block_index int, block_type string, style string, text string, char_count int, row_count int, max_column_count int, image_count int, rows array<array<string>>, images array<string>"


def html_text(c: Column) -> Column:
    """Text of an HTML fragment: tags out, the five named entities decoded, white space collapsed."""
    text = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_blocks(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """id, block_index, block_type (h1 to h6, p, li, td, pre), text of each block of each page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<((?:h[1-6]|p|li|td|pre)\b[^>]*>.*?</(?:h[1-6]|p|li|td|pre))>"), F.lit(1))
    blocks = pages.select(id_, F.posexplode(found).alias("block_index", "raw"))
    kind = F.lower(F.regexp_extract("raw", r"^(\w+)", 1))
    return blocks.select(id_, "block_index", kind.alias("block_type"), html_text(F.regexp_replace("raw", r"(?s)^[^>]*>|</\w+$", "")).alias("text"))


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t"))


def docx_rows(path: str, data: bytes) -> list[tuple]:
    """Paragraphs and tables of the body of a Word file, in order; a broken file gives none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
            rels = {}
            if "word/_rels/document.xml.rels" in z.namelist():
                for r in ET.fromstring(z.read("word/_rels/document.xml.rels")).iter(f"{PACKAGE}Relationship"):
                    rels[r.get("Id")] = posixpath.normpath(posixpath.join("word", r.get("Target", "")))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    out = []
    for node in body if body is not None else ():
        images = [rels.get(b.get(f"{REL}embed")) for b in node.iter(f"{DRAWING}blip")]
        images = [i for i in images if i]
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            text = _text(node).strip()
            if text or images:
                out.append((path, len(out), "paragraph", style.get(f"{W}val") if style is not None else None, text, len(text), 0, 0, len(images), [], images))
        elif node.tag == f"{W}tbl":
            rows = [[_text(c).strip() for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")]
            text = "\n".join(" | ".join(r) for r in rows)
            out.append((path, len(out), "table", None, text, len(text), len(rows), max(map(len, rows), default=0), len(images), rows, images))
    return out


def docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all Word files under ``path``; one file is one row of the scan, so files spread over the cluster."""

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(docx_rows(p, bytes(data)), columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, BLOCKS)


def docx_media(spark: SparkSession, path: str) -> DataFrame:
    """path, part_name (word/media/...), content of every picture in the Word files under ``path``; a broken file gives none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        found = [(p, n, z.read(n)) for n in z.namelist() if n.startswith("word/media/") and not n.endswith("/")]
                except zipfile.BadZipFile:
                    continue
                for row in found:  # a picture at a time
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]]), pa.array([row[2]], pa.binary())], names=["path", "part_name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, part_name string, content binary")


def cell_refs(blocks: DataFrame, id_: str, block: str, text: str) -> DataFrame:
    """id, cell_ref (B_R_C), text of every non-empty cell of tables written as lines of cells divided by bars; numbers count blanks too."""
    rows = blocks.select(id_, block, F.posexplode(F.split(text, "\n")).alias("r", "line"))
    cells = rows.select(id_, block, "r", F.posexplode(F.split("line", r"\|")).alias("c", "cell"))
    ref = F.concat(F.lit("B"), F.col(block), F.lit("_R"), F.col("r"), F.lit("_C"), F.col("c"))
    return cells.where(F.trim("cell") != "").select(id_, ref.alias("cell_ref"), F.trim("cell").alias("text"))


def cell_neighbours(cells: DataFrame, by: list[str], row: str, cell: str, text: str) -> DataFrame:
    """``cells`` with the texts left, right, above and below."""
    from pyspark.sql import Window

    across, down = Window.partitionBy(*by, row).orderBy(cell), Window.partitionBy(*by, cell).orderBy(row)
    return cells.withColumns({"left_text": F.lag(text).over(across), "right_text": F.lead(text).over(across), "above_text": F.lag(text).over(down), "below_text": F.lead(text).over(down)})
