"""Files as documents: text with a Latin-1 fallback, PDF where its library is there."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import Settings
from ..errors import ChunkingError, DocumentLoadError
from ..functions import expr
from ..functions.types import ALIASES
from ..functions.types import document_type as typed
from ..operators.chunk import CHUNK_FIELDS, clean_up, counter
from ..operators.structured import Piece, legal, plain


def decode(raw) -> F.Column:
    """UTF-8, or Latin-1 where that fails; both natively."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def read_documents(spark: SparkSession, paths: Sequence[str] | str, document_type: str) -> DataFrame:
    """(``document_id``, ``document_type``, ``source``, ``content``) of all files; a missing one is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        df = spark.read.format("binaryFile").load(paths)
    except Exception as e:
        raise DocumentLoadError(f"can't read {paths}: {str(e).splitlines()[0]}") from e
    name = F.regexp_replace("path", r"^.*/", "")
    return df.select(expr.slug(expr.stem(name)).alias("document_id"), typed(F.lit(document_type)).alias("document_type"), name.alias("source"), decode(F.col("content")).alias("content"))


def table_markdown(rows: Sequence[Sequence | None]) -> str:
    """``expr.markdown_table`` for one table on the driver or in a task."""

    def cell(c) -> str:
        flat = " ".join(str(c).split("\n")) if c is not None else ""
        return "\\|".join(flat.split("|")).strip()

    clean = [list(map(cell, r)) for r in rows if r is not None]
    clean = [r for r in clean if any(r)]
    if len(clean) < 2:
        return ""
    width = max(map(len, clean))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(clean[0]), "|" + " --- |" * width, *map(line, clean[1:])])


def chunk_pdf(raw: bytes, kind: str, domain: str, s: Settings, source: str = "") -> list[Piece]:
    """Chunks of a PDF: its text as a contract or plainly, then each table by itself with its page."""
    text, tables = pdf_text(raw, s.labels["page"])
    count = counter(s)
    is_legal = kind == "legal" or ALIASES.get(domain.lower()) == "legal"
    out = (legal if is_legal else plain)(text, s, count, source)
    for page, rows, context in tables:
        if body := table_markdown(rows):
            where = f"{s.labels['page']} {page}"
            out.append(Piece(f"[{s.labels['context']}: {where}{f' – {context}' if context else ''}]\n\n{body}", "table", path=[where], extra={"page": page, "isolated_structure": True}))
    out = clean_up(out, s, count)
    if not out:
        raise ChunkingError(f"{source!r} gives no chunk (keine Chunks)")
    return out


def pdf_chunks(spark: SparkSession, paths: Sequence[str] | str, kind: str, domain: str, s: Settings) -> DataFrame:
    """Chunks of PDF files with ``document_id``, ``document_type`` and ``source``; a task reads the files that it holds."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        files = spark.read.format("binaryFile").load(paths)
    except Exception as e:
        raise DocumentLoadError(f"can't read {paths}: {str(e).splitlines()[0]}") from e
    name = F.regexp_replace("path", r"^.*/", "")
    slugged = expr.slug(expr.stem(name))
    files = files.select(F.when(slugged != "", slugged).otherwise(F.md5(name)).alias("document_id"), name.alias("source"), "content")
    fields = "document_id string, document_type string, source string, " + CHUNK_FIELDS.rpartition(", ")[0]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ident, source, raw = (c[k].as_py() for c in batch.columns)
                pieces = chunk_pdf(raw, kind, domain, s, source)
                rows = [(ident, kind, source, p.serial, p.parent, p.kind, p.role, p.path, p.searchable, p.tokens, p.content, json.dumps(p.extra, ensure_ascii=False, sort_keys=True)) for p in pieces]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = spark.createDataFrame([], fields).schema
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    return files.mapInArrow(run, schema)


def pdf_text(raw: bytes, page_label: str = "Seite") -> tuple[str, list[tuple[int, list, str]]]:
    """Text with page marks, and (page, rows, context) of each table; needs pdfplumber."""
    try:
        import pdfplumber
    except ImportError as e:
        raise DocumentLoadError("PDF needs the pdfplumber package") from e
    import io

    pages, tables = [], []
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        for k, page in enumerate(pdf.pages, 1):
            text = page.extract_text() or ""
            pages.append(f"[{page_label} {k}]\n{text}")
            try:
                found = page.extract_tables()
            except Exception:  # tables are best effort, page by page
                found = []
            tables += [(k, rows, " ".join(text.split())[:300]) for rows in found]
    return "\n\n".join(pages), tables
