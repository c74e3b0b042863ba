"""Registered queries over generated documents whose chunks can be written down.

A template becomes a document for each row of a table: ``@`` stands for the row's
key. The SQL holds the expected chunks, written out by hand from the rules, and
compares order, parents, kinds and contents, by md5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators.chunk import chunk_documents, spread


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def expected_sql(table: str, key: str, rows: list[tuple]) -> str:
    """SQL of the expected chunks: (sequence, parent, type, role, hierarchy, searchable, content) of each row of a table."""
    values = ", ".join(f"({n}, {'NULL' if p is None else p}, {quoted(kind)}, {quoted(role)}, {quoted(path)}, {str(on).lower()}, {quoted(text)})" for n, p, kind, role, path, on, text in rows)
    return (
        f"SELECT {key} AS key, CAST(sequence AS INTEGER) AS sequence, CAST(parent AS INTEGER) AS parent_sequence, chunk_type, chunk_role, replace(path, '@', CAST({key} AS VARCHAR)) AS path, searchable, "
        f"md5(replace(content, '@', CAST({key} AS VARCHAR))) AS content_md5 FROM {table}, (VALUES {values}) AS t(sequence, parent, chunk_type, chunk_role, path, searchable, content)"
    )


def chunked(docs: DataFrame, s: Settings | None = None, **options) -> DataFrame:
    out = chunk_documents(docs, s, **options)
    return out.select("key", "sequence", "parent_sequence", "chunk_type", "chunk_role", F.array_join("hierarchy", " > ").alias("path"), "searchable", F.md5("content").alias("content_md5"))


class Template:
    """A document template over a table's key, with its type, source and settings, and its expected chunks."""

    def __init__(self, table: str, key: str, document_type: str, text: str, rows: list[tuple], source: str = "", settings: Settings | None = None):
        self.table, self.key, self.kind, self.text, self.source, self.settings = table, key, document_type, text, source, settings
        self.sql = expected_sql(table, key, rows)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col(self.key).cast("string")
        docs = spread(spark.read.parquet(f"{sf_dir}/{self.table}.parquet"), self.key).select(F.col(self.key).alias("key"), F.replace(F.lit(self.text), F.lit("@"), key).alias("content"), F.lit(self.kind).alias("document_type"), F.lit(self.source).alias("source"))
        return chunked(docs, self.settings)


TEMPLATES: dict[str, Template] = {}

# brace languages: a unit for each signature, in order, then what lies between

_UNITS = [
    'export async function load@(a) {\n  return "}" + a; // }\n}',
    "func (s *Store) Get@(x int) int {\n\t/* { */\n\treturn x\n}",
    "pub fn run@(x: i32) -> i32 {\n    x + 1\n}",
    "public static int calc@(int a) {\n    return a;\n}",
    "class Part@ {\n  constructor() { this.k = `}`; }\n}",
    "const twice@ = (x) => {\n  return 2 * x;\n};",
]
_LINE = "let limit@ = 5;"
TEMPLATES["brace_code_units"] = Template(
    "part", "p_partkey", "code", _LINE + "\n" + "\n".join(_UNITS), [(n, None, "code_unit", "standalone", "", True, f"// Datei: units.ts\n{t}") for n, t in enumerate([*_UNITS, _LINE])], "units.ts"
)

# a class above twice the chunk budget: a capped parent, its header and its methods

_S64 = Settings(chunk_max_tokens=64, parent_max_tokens=256, chunk_overlap_tokens=0, min_chunk_tokens=1)
_METHODS = [f"    def m{k}(self):\n        return [{', '.join(['@'] * 8)}, {k}]" for k in range(9)]
_CLASS = "class Big@:\n    size = 1\n\n" + "\n\n".join(_METHODS)


def _large_class() -> list[tuple]:
    head = "# Datei: big.py\n"
    rows = [(0, None, "code_unit", "parent", "", False, head + _CLASS), (1, 0, "code_unit", "child", "", True, head + "class Big@:\n    size = 1")]
    return rows + [(2 + k, 0, "code_unit", "child", "", True, f"{head}# Kontext: class Big@:\n{m}") for k, m in enumerate(_METHODS)]


TEMPLATES["large_class_methods"] = Template("part", "p_partkey", "code", _CLASS, _large_class(), "big.py", Settings(chunk_max_tokens=64, parent_max_tokens=2000, chunk_overlap_tokens=0, min_chunk_tokens=1))

# SQL: COPY rows in parts, comments, dollar quotes, and statements of no table

_ROWS = [f"{k:03d}\tvalue-{'x' * 40}" for k in range(12)]
_COPY = "COPY public.items (id, name) FROM stdin;"
# a part has 256 characters: the header's 40, then rows of 50 and a line end each
_PARTS = [_ROWS[k : k + 4] for k in range(0, 12, 4)]
TEMPLATES["copy_blocks"] = Template(
    "supplier", "s_suppkey", "sql", "CREATE TABLE public.items (id int, name text);\n" + "\n".join([_COPY, *_ROWS, "\\."]) + "\nSELECT @;",
    [(0, None, "sql_statement", "parent", "", True, "-- Schema für Tabelle: items\nCREATE TABLE public.items (id int, name text);")]
    + [(1 + n, 0, "sql_statement", "child", "", True, "\n".join([_COPY, *p, "\\."])) for n, p in enumerate(_PARTS)]
    + [(4, None, "sql_statement", "standalone", "", True, "-- Allgemeine Dump-Anweisungen\nSELECT @;")],
    settings=_S64,
)

_FUNCTION = "CREATE FUNCTION f@() RETURNS int AS $body$ BEGIN; RETURN ';'; END; $body$ LANGUAGE plpgsql;"
TEMPLATES["dollar_quotes"] = Template(
    "supplier", "s_suppkey", "sql",
    f"-- a comment; with a semicolon\nCREATE TABLE hidden (a int);\n{_FUNCTION}\n/* ; */ INSERT INTO \"My\".\"T\" VALUES ('it''s; @');\nCREATE UNIQUE INDEX i ON t (a);\nINSERT INTO t VALUES (@);",
    [(0, None, "sql_statement", "parent", "", True, "-- Schema für Tabelle: t\nCREATE UNIQUE INDEX i ON t (a);"),
     (1, 0, "sql_statement", "child", "", True, "-- Daten für Tabelle: t (Batch 1)\nINSERT INTO t VALUES (@);"),
     (2, None, "sql_statement", "standalone", "", True, f"-- Allgemeine Dump-Anweisungen\n-- a comment; with a semicolon\nCREATE TABLE hidden (a int);\n{_FUNCTION}\n/* ; */ INSERT INTO \"My\".\"T\" VALUES ('it''s; @');")],
)

# contracts: paragraphs (1), (2), ... are packed whole; one above the budget is split by itself

_P = [f"({k}) " + " ".join(["Klausel"] * 10) + "." for k in range(1, 6)]  # 85 characters with the line end, 22 tokens: two fit 64
_LONG = "(6) " + " ".join(["Satzwort"] * 56)  # 507 characters: 256 are 28 words (4 + 28 * 9), then 28
TEMPLATES["legal_overflow"] = Template(
    "supplier", "s_suppkey", "vertrag", "§ 1 Pflichten\n" + "\n".join(_P) + "\n" + _LONG,
    [(0, None, "section", "parent", "§ 1 Pflichten", False, "[Kontext: § 1 Pflichten]\n\n§ 1 Pflichten\n\n" + "\n".join(_P) + "\n" + _LONG),
     (1, 0, "legal_clause", "child", "§ 1 Pflichten", True, "[Kontext: § 1 Pflichten]\n\n§ 1 Pflichten\n" + "\n".join(_P[:2])),
     (2, 0, "legal_clause", "child", "§ 1 Pflichten", True, "[Kontext: § 1 Pflichten]\n\n" + "\n".join(_P[2:4])),
     (3, 0, "legal_clause", "child", "§ 1 Pflichten", True, "[Kontext: § 1 Pflichten]\n\n" + _P[4]),
     (4, 0, "legal_clause", "child", "§ 1 Pflichten", True, "[Kontext: § 1 Pflichten]\n\n(6) " + " ".join(["Satzwort"] * 28)),
     (5, 0, "legal_clause", "child", "§ 1 Pflichten", True, "[Kontext: § 1 Pflichten]\n\n" + " ".join(["Satzwort"] * 28))],
    settings=_S64,
)

# plain text: numbered titles and lines of capitals are headings; fences and HTML tables are blocks

TEMPLATES["plain_headings"] = Template(
    "supplier", "s_suppkey", "text", "Vorwort @.\n\n1. Einleitung\nErster Teil.\n\n1.1 Ziele\nZweiter Teil.\n\nALLGEMEINE REGELN\nDritter Teil, @.",
    [(0, None, "text", "standalone", "", True, "Vorwort @."),
     (1, None, "text", "standalone", "1. Einleitung", True, "[Kontext: 1. Einleitung]\n\n1. Einleitung\n\nErster Teil."),
     (2, None, "text", "standalone", "1. Einleitung > 1.1 Ziele", True, "[Kontext: 1. Einleitung > 1.1 Ziele]\n\n1.1 Ziele\n\nZweiter Teil."),
     (3, None, "text", "standalone", "ALLGEMEINE REGELN", True, "[Kontext: ALLGEMEINE REGELN]\n\nALLGEMEINE REGELN\n\nDritter Teil, @.")],
)

_HTML = "<table>\n<tr><td>@</td></tr>\n</table>"
_FENCED = "```\n# no heading\n| a | b |\n```"
TEMPLATES["markdown_blocks"] = Template(
    "supplier", "s_suppkey", "md", f"# Titel @\n\nText davor.\n\n{_HTML}\n\n{_FENCED}\n\n## Unter\n\nText.\n\n# Neu\n\n~~~\nunclosed @",
    [(0, None, "section", "parent", "Titel @", False, f"[Kontext: Titel @]\n\n# Titel @\n\nText davor.\n\n{_FENCED}"),
     (1, 0, "text", "child", "Titel @", True, f"[Kontext: Titel @]\n\n# Titel @\n\nText davor.\n\n{_FENCED}"),
     (2, 0, "table", "child", "Titel @", True, f"[Kontext: Titel @]\n\n[Übergeordneter Textkontext: Text davor.]\n\n{_HTML}"),
     (3, None, "text", "standalone", "Titel @ > Unter", True, "[Kontext: Titel @ > Unter]\n\n## Unter\n\nText."),
     (4, None, "text", "standalone", "Neu", True, "[Kontext: Neu]\n\n# Neu\n\n~~~\nunclosed @")],
)

# JSON: fragments of groups of keys and parts of long texts hang on a parent that tells the shape

JSON = '{"a": {"b": [1, 2]}, "list": [{"x": 1.5, "y": null}], "empty": [], "flag": true, "text": "' + " ".join(["abcdefghi"] * 40) + '"}'
_SHAPE = "JSON-Dokument – Strukturübersicht:\na:\n  b:\n    Array mit 2 Elementen (Typ: int)\nlist:\n  Array mit 1 Elementen (Typ: dict)\n    x: float\n    y: NoneType\nempty:\n  Array mit 0 Elementen (Typ: leer)\nflag: bool\ntext: str"
TEMPLATES["json_shape"] = Template(
    "supplier", "s_suppkey", "json", JSON,
    [(0, None, "section", "parent", "", False, _SHAPE),
     (1, 0, "json_fragment", "child", "", True, 'JSON-Pfad: $.{a,list,empty,flag}\n{\n  "a": {\n    "b": [\n      1,\n      2\n    ]\n  },\n  "list": [\n    {\n      "x": 1.5,\n      "y": null\n    }\n  ],\n  "empty": [],\n  "flag": true\n}'),
     (2, 0, "json_fragment", "child", "", True, "JSON-Pfad: $.text (Teil 1/2)\n" + " ".join(["abcdefghi"] * 25)),
     (3, 0, "json_fragment", "child", "", True, "JSON-Pfad: $.text (Teil 2/2)\n" + " ".join(["abcdefghi"] * 15))],
    settings=_S64,
)

_GOOD = [f'{{"k": {k}, "u": @}}' for k in range(5)]
TEMPLATES["ndjson_broken_line"] = Template(
    "supplier", "s_suppkey", "ndjson", "\n".join([*_GOOD[:2], "{broken", *_GOOD[2:], ""]),
    [(0, None, "json_fragment", "standalone", "", True, "JSON-Pfad: $\n[\n" + ",\n".join(f'  {{\n    "k": {k},\n    "u": @\n  }}' for k in range(5)) + "\n]")],
)

QUERIES = dict(TEMPLATES)
ORACLE_SQL = {k: t.sql for k, t in TEMPLATES.items()}


# windows over words of nine letters

_COUNT = "1 + (c_custkey * 37) % 900"
_TEXT_SQL = f"d AS (SELECT c_custkey AS key, CAST({_COUNT} AS BIGINT) AS n FROM customer)"
_WORD_SQL = "lpad(CAST(i AS VARCHAR), 9, 'w')"


def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer, a text of 1 to 900 numbered words of nine letters."""
    words = F.transform(F.sequence(F.lit(0), F.expr(f"cast({_COUNT} as int) - 1")), lambda i: F.lpad(i.cast("string"), 9, "w"))
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").select(F.col("c_custkey").alias("key"), F.array_join(words, " ").alias("content"))


def window_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1,920 characters hold 192 words; the tail of 256 has 25 whole ones, so the next begins 167 words on."""
    from .operators.chunk import windows

    return windows(word_documents(spark, sf_dir), "content", 480, 64, 24).select("key", "ord", F.md5("piece").alias("piece_md5"))


_CUT = f"WITH {_TEXT_SQL}, o AS (SELECT key, n, unnest(generate_series(0, CASE WHEN n <= 192 THEN 0 ELSE CAST(ceil((n - 192) / 167.0) AS BIGINT) END)) AS ord FROM d), p AS (SELECT key, n, ord, (SELECT string_agg({_WORD_SQL}, ' ' ORDER BY i) FROM (SELECT unnest(generate_series(ord * 167, least(n, ord * 167 + 192) - 1)) AS i)) AS piece FROM o)"
QUERIES["window_pieces"] = window_pieces
ORACLE_SQL["window_pieces"] = f"{_CUT} SELECT key, CAST(ord AS INTEGER) AS ord, md5(piece) AS piece_md5 FROM p"


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts through the plain chunker: where there are several windows, a parent of 7,200 characters at most stands before them."""
    return chunked(word_documents(spark, sf_dir).withColumn("document_type", F.lit("text")))


QUERIES["word_chunks"] = word_chunks
ORACLE_SQL["word_chunks"] = (
    f"{_CUT}, t AS (SELECT key, n, (SELECT string_agg({_WORD_SQL}, ' ' ORDER BY i) FROM (SELECT unnest(generate_series(0, n - 1)) AS i)) AS text FROM d) "
    "SELECT key, CAST(ord + CASE WHEN n > 192 THEN 1 ELSE 0 END AS INTEGER) AS sequence, CAST(CASE WHEN n > 192 THEN 0 END AS INTEGER) AS parent_sequence, 'text' AS chunk_type, CASE WHEN n > 192 THEN 'child' ELSE 'standalone' END AS chunk_role, '' AS path, true AS searchable, md5(piece) AS content_md5 FROM p "
    "UNION ALL SELECT key, CAST(0 AS INTEGER), CAST(NULL AS INTEGER), 'section', 'parent', '', false, md5(CASE WHEN length(text) > 7200 THEN substr(text, 1, 7199) || chr(10) || '… [Inhalt für Parent-Kontext gekürzt]' ELSE text END) FROM t WHERE n > 192"
)


def failing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``fail`` off, a document that can't be chunked gives one row with its error; the rest go on."""
    kind = F.when(F.col("s_suppkey") % 4 == 0, "pdf").otherwise("text")
    text = F.when(F.col("s_suppkey") % 4 == 1, F.lit("  \n")).otherwise(F.col("s_name"))
    docs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), text.alias("content"), kind.alias("document_type"))
    return chunk_documents(docs, fail=False).select("key", "sequence", F.col("error").isNotNull().alias("failed"), F.md5("content").alias("content_md5"))


QUERIES["failing_documents"] = failing_documents
ORACLE_SQL["failing_documents"] = "SELECT s_suppkey AS key, CAST(CASE WHEN s_suppkey % 4 > 1 THEN 0 END AS INTEGER) AS sequence, s_suppkey % 4 < 2 AS failed, CASE WHEN s_suppkey % 4 > 1 THEN md5(s_name) END AS content_md5 FROM supplier"
