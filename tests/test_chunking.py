import ast
import json
import math
import re

import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st

from lakeseek.config import Settings
from lakeseek.errors import ChunkingError, ConfigurationError
from lakeseek.functions.types import normalise_type
from lakeseek.operators import code as cd
from lakeseek.operators import jsonfrag as jf
from lakeseek.operators import sqldump as sd
from lakeseek.operators import structured as stc
from lakeseek.operators.chunk import CHUNKERS, chunk_documents, chunk_text, clean_up, windows
from lakeseek.operators.split import cap, estimate, split_text

S = Settings()
GUIDE = "# Guide\n\nWelcome.\n\n## Prices\nThe prices of all plans follow.\n\n| plan | price |\n|------|-------|\n| basic | 10 |\n| plus | 20 |\n| max | 30 |\n\n## Support\nWrite a mail.\n\n## Notes\nNone.\n"


def check(pieces):
    assert [p.serial for p in pieces] == list(range(len(pieces)))
    for p in pieces:
        assert p.content.strip()
        if p.role == "child":
            assert pieces[p.parent].role == "parent"


def test_estimate():
    assert [estimate("x" * n) for n in (0, 1, 4, 5, 20)] == [1, 1, 1, 2, 5]


def test_split_basics():
    assert split_text("  \n ", 64) == [] and split_text(" a b ", 64) == ["a b"]
    assert split_text("x" * 10, 1) == ["xxxx", "xxxx", "xx"]
    parts = split_text("one two three four five six seven eight nine ten. " * 30, 64, 16)
    assert all(len(p) <= 256 for p in parts[:-1])
    for a, b in zip(parts, parts[1:]):
        assert b.split()[0] in a
    tail = split_text("a" * 256 + "\n\nend", 64, 0, min_tokens=24)
    assert tail == ["a" * 256 + "\nend"]


def window_reference(text, size, overlap, least):
    """The rule in its plainest form, for comparison."""

    def cut(t, level):
        if len(t) <= size:
            return [t]
        if level == 4:
            return [t[i : i + size] for i in range(0, len(t), size)]
        pattern = (r"\n\n+", "\n", r"(?<=[;:?!.])\s", r"\s\s*")[level]
        bounds = [0, *(m.end() for m in re.finditer(pattern, t)), len(t)]
        return [a for x, y in zip(bounds, bounds[1:]) if y > x for a in cut(t[x:y], level + 1)]

    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out, now = [], ""
    for atom in cut(text, 0):
        if len(now) + len(atom) > size:
            if now.strip():
                out.append(now.strip())
            keep = now[-overlap:] if overlap else ""
            at = keep.find(" ")
            if at >= 0 and at + 1 < len(keep):
                keep = keep[at + 1 :]
            now = keep if len(keep) + len(atom) <= size else ""
        now += atom
    if now.strip():
        out.append(now.strip())
    if len(out) >= 2 and max(1, math.ceil(len(out[-1]) / 4)) < least:
        last = out.pop()
        out[-1] += "\n" + last
    return out


@hyp(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\té", max_size=400), st.integers(1, 20), st.integers(0, 9), st.integers(1, 8))
def test_split_properties(text, budget, overlap, least):
    parts = split_text(text, budget, overlap, least)
    size = 4 * budget
    assert parts == window_reference(text, size, min(4 * overlap, size // 3), least)
    if not overlap:
        assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
    assert all(len(p) <= size for p in parts[:-2])


def test_cap():
    assert cap("abc", 1, "!") == "abc" and cap("abc def ghi", 2, "!") == "abc def!" and cap("x" * 9, 2, "!") == "x" * 8 + "!"


def test_types():
    assert normalise_type(" SQL-dump ") == "sql_dump" and normalise_type("contract") == "legal"
    with pytest.raises(ValueError):
        normalise_type("spreadsheet")


def test_markdown_isolates_tables():
    got = chunk_text(GUIDE, "md")
    check(got)
    tables = [p for p in got if p.kind == "table"]
    assert len(tables) == 1 and tables[0].content.count("|\n") >= 4 and "The prices of all plans follow." in tables[0].content
    assert tables[0].path == ["Guide", "Prices"] and tables[0].extra == {"isolated_structure": True}
    assert not got[tables[0].parent].searchable


def test_blocks():
    kinds = lambda t: [b.kind for b in stc.blocks_of(t, stc.markdown_heading)]
    assert kinds("```py\n# no heading\n| a |\n") == ["code"]
    assert kinds("x\n<table><tr>\n</TABLE>\ny") == ["text", "table", "text"]
    assert kinds("| a |\nno rule") == ["text"]
    assert kinds("~~~~\nx\n~~~ \n# H") == ["code", "heading"]
    deep = stc.sections_of(stc.blocks_of("# A\n### B\n## C\nx", stc.markdown_heading))
    assert [s.path for s in deep] == [["A"], ["A", "B"], ["A", "C"]]


def test_headings():
    h = stc.legal_heading
    assert [h(x) and h(x)[0] for x in ("Teil I", "Kapitel 2", "Anlagevermögen", "Präambel:", "§ 5 Abs. 2 gilt", "Artikel 12", "3.2 Haftung", "3.2 haftung", "3. Er haftet.", "# X")] == [1, 2, 2, 2, 3, 3, 3, None, None, 1]
    p = stc.plain_heading
    assert [p(x) and p(x)[0] for x in ("2.1 System", "ALLGEMEINE HINWEISE", "Ein Satz.", "abc", "1 klein", "Normal line")] == [3, 2, None, None, None, None]


def test_legal_keeps_paragraphs():
    text = "Vertrag\n§ 1 Dauer\n(1) Erster Absatz.\n(2) Zweiter Absatz.\n§ 2 Preis\n(1) " + "Wort " * 400 + "\n(2) Ende.\n"
    got = chunk_text(text, "legal")
    check(got)
    assert any(p.path == ["§ 1 Dauer"] and "(1)" in p.content and "(2)" in p.content for p in got)
    assert sum("§ 2 Preis" in p.path for p in got) >= 3


def test_python_units():
    src = '"""Doc."""\nimport os\nX = 1\n\n@cache\ndef f(a):\n    return a\n\n\nclass C:\n    y = 2\n\n    def m(self):\n        return 1\n\n    async def n(self):\n        return 2\n'
    got = chunk_text(src, "code", S, "m.py")
    check(got)
    assert [p.extra.get("qualname") for p in got] == [None, "f", "C"] and "@cache" in got[1].content
    big = "class Big:\n    size = 1\n" + "".join(f"\n    def m{k}(self):\n        return '{'x' * 300}'\n" for k in range(16))
    got = chunk_text(big, "code", S, "big.py")
    check(got)
    assert [p.extra["kind"] for p in got] == ["class", "class_header"] + ["method"] * 16 and got[2].extra["qualname"] == "Big.m0"
    with pytest.raises(ChunkingError):
        cd.python("# only a comment\n", S, source="c.py")
    assert chunk_text("def f(:\n  {\n}", "code", S, "broken.py")[0].extra["kind"] == "module"


def test_brace_units():
    src = "const a = 1;\nexport async function go(x) {\n  if (x) { return \"}\"; } // }\n  /* } */\n}\npub fn run() -> i32 {\n  1\n}\nfunc (s *T) Do(a int) {\n}\npublic static int Add(int a) {\n return a;\n}\nconst f = (a) => {\n  return `}`;\n};\nclass K {\n}\n"
    got = cd.braces(src, S, source="x.js")
    assert [p.extra.get("qualname") for p in got] == ["go", "run", "Do", "Add", "f", "K", None]
    assert cd.block_end(["function f()", "", "", "{", "}"], 0) is None
    assert chunk_text("plain words only", "code", S, "a.txt")[0].extra["kind"] == "module"


def test_json():
    data = {"service": "s", "rows": [{"id": k, "name": f"n{k}", "note": "x" * 50} for k in range(60)], "page": {"n": 1}}
    got = chunk_text(json.dumps(data), "json", S, "api.json")
    check(got)
    assert not got[0].searchable and "rows:" in got[0].content
    ids = []
    for p in got[1:]:
        assert p.content.startswith(f"JSON-Pfad: {p.extra['json_path']}\n")
        body = json.loads(p.content.split("\n", 1)[1])
        ids += [r["id"] for r in body] if isinstance(body, list) else []
    assert ids == list(range(60))
    assert jf.parse('{"a": 1}\nbroken\n{"a": 2}') == [{"a": 1}, {"a": 2}]
    with pytest.raises(ChunkingError):
        jf.parse("x\ny\n{}")
    long = list(jf.fragments("$", {"t": "word " * 1000}, S))
    assert long[0][0].startswith("$.t (Teil 1/")


def test_sql():
    dump = "BEGIN;\nCREATE TABLE public.\"Users\" (id int, n text);\nCREATE INDEX i ON public.\"Users\" (id);\n" + "".join(f"INSERT INTO \"Users\" VALUES ({k}, 'a;''b');\n" for k in range(80)) + "COMMIT;"
    got = chunk_text(dump, "sql")
    check(got)
    schema = [p for p in got if p.extra.get("kind") == "schema"]
    data = [p for p in got if p.extra.get("kind") == "insert_batch"]
    assert len(schema) == 1 and schema[0].searchable and "INDEX" in schema[0].content
    assert len(data) >= 2 and sum(p.extra["statement_count"] for p in data) == 80 and all(p.parent == schema[0].serial for p in data)
    assert sd.scan("a; -- x;y\nb /* ; */; $t$ ; $t$; 'x;' ; \"q;\"; `r;`") == ["a;", "-- x;y\nb /* ; */;", "$t$ ; $t$;", "'x;' ;", '"q;";', "`r;`"]
    copy = "COPY t (a) FROM stdin;\n" + "\n".join("r" * 90 for _ in range(60)) + "\n\\.\nSELECT 1;"
    parts = chunk_text(copy, "sql")
    assert all(p.content.startswith("COPY t (a) FROM stdin;") and p.content.endswith("\\.") for p in parts[:-1]) and len(parts) > 3
    hidden = "-- note\nCREATE TABLE t (a int);"
    assert chunk_text(hidden, "sql")[0].extra["kind"] == "misc"
    assert chunk_text(hidden, "sql", Settings(strip_leading_comments=True))[0].extra["kind"] == "schema"


def test_tables_too_long():
    rows = "\n".join(f"| {k} | {'x' * 40} |" for k in range(100))
    text = f"# T\n\nAbove.\n\n| a | b |\n|---|---|\n{rows}\n"
    split = [p for p in chunk_text(text, "md") if p.kind == "table"]
    assert len(split) > 1 and "split_part" in split[0].extra and "| a | b |" not in split[1].content
    whole = [p for p in chunk_text(text, "md", Settings(keep_tables_whole=True)) if p.kind == "table"]
    assert len(whole) == 1
    hard = [p for p in chunk_text(text, "md", Settings(table_hard_max_tokens=256)) if p.kind == "table"]
    assert all("| a | b |\n|---|---|" in p.content and f"[Tabellen-Teil {k}/{len(hard)}]" in p.content for k, p in enumerate(hard, 1))
    assert sum(len(re.findall(r"^\| \d", p.content, re.M)) for p in hard) == 100
    headers = stc.Piece("| a | b |\n|---|---|" + " " * 2000, "table")
    assert len(clean_up([stc.Piece("| " + "x" * 3000 + " |\n|---|", "table")], Settings(table_hard_max_tokens=256), estimate)) == 0
    assert clean_up([headers], S, estimate)


def test_errors_and_settings():
    for text, kind in (("  ", "text"), ("x", "pdf"), ("", "sql"), ("{", "json")):
        with pytest.raises(ChunkingError):
            chunk_text(text, kind)
    with pytest.raises(ConfigurationError):
        Settings(chunk_max_tokens=10)
    with pytest.raises(ConfigurationError):
        chunk_text("x", "text", Settings(tokenizer_backend="hf", tokenizer_model="/nowhere"))
    assert set(CHUNKERS) == {"markdown", "legal", "text", "json", "api_payload", "code", "sql_dump"}
    ast.parse("1")


def test_frames_agree_with_functions(spark):
    texts = [(1, GUIDE, "md"), (2, "A" * 5000, "text"), (3, "§ 1 X\n(1) a", "law"), (4, " ", "text"), (5, None, "text")]
    df = spark.createDataFrame(texts, "id long, content string, document_type string")
    got = {}
    for n in (1, 3):
        rows = chunk_documents(df.repartition(n), fail=False).orderBy("id", "sequence").collect()
        got[n] = [tuple(r) for r in rows]
    assert got[1] == got[3]
    for k, text, kind in texts[:3]:
        mine = [(r.sequence, r.parent_sequence, r.content) for r in rows if r.id == k]
        assert mine == [(p.serial, p.parent, p.content) for p in chunk_text(text, kind)]
    assert all(r.error for r in rows if r.id > 3)
    w = windows(df.select("id", "content"), "content", 64, 8, 2).where("id = 2").orderBy("ord").collect()
    assert [r.piece for r in w] == split_text("A" * 5000, 64, 8, 2)
    assert chunk_documents(df.limit(0)).count() == 0
