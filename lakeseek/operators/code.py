"""Chunkers for source code: Python by its syntax tree, brace languages by signatures and brace matching."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from pathlib import PurePath

from ..config import Settings
from ..errors import ChunkingError
from .split import Counter, cap, estimate, split_text
from .structured import Piece

_HINT = re.compile(r"^\s*(?:class |def |from \w|import )", re.M)
_NAME = r"([$A-Z_a-z][$\w]*)"
_GO_NAME = r"([A-Za-z_]\w*)"


def _maybe(word: str) -> str:
    return rf"(?:{word}\s+)?"


_EQUALS = r"\s*=\s*"
_PARENS = r"\([^)]*\)"
_START = r"\s*"
_EXPORT = _START + _maybe("export")
#: Signatures that open a unit: the first group, if any, is its name.
_OPENERS = tuple(
    map(
        re.compile,
        (
            _EXPORT + _maybe("default") + _maybe("async") + r"function\s*\*?\s*" + _NAME + r"?\s*\(",
            _EXPORT + _maybe("abstract|public") + r"class\s+" + _NAME,
            _EXPORT + r"(?:var|let|const)\s+" + _NAME + _EQUALS + r"(?:async\s*)?" + "(?:" + _NAME[1:-1] + "|" + _PARENS + r")\s*=>",
            _START + r"func\s+(?:" + _PARENS + r"\s*)?" + _GO_NAME + r"\s*\(",
            _START + _maybe(f"pub(?:{_PARENS})?") + _maybe("async") + r"fn\s+" + _GO_NAME,
            _START + r"(?:static|internal|protected|private|public)[\w\s<>,\[\]]*\s" + _GO_NAME + r"\s*\([^;]*\)" + r"\s*\{?\s*\Z",
        ),
    )
)


def code(text: str, s: Settings, count: Counter = estimate, source: str = "") -> list[Piece]:
    """Python where the suffix says so, or without suffix where two lines look like it; else by braces."""
    suffix = PurePath(source).suffix.lower() if source else ""
    if suffix in (".py", ".pyi") or not suffix and len(_HINT.findall(text)) > 1:
        try:
            return python(text, s, count, source)
        except SyntaxError:
            pass
    return braces(text, s, count, source)


class _Source:
    def __init__(self, text: str):
        self.lines = text.split("\n")

    def span(self, node: ast.stmt) -> tuple[int, int]:
        """Lines of a statement, decorators included; from 0, end excluded."""
        starts = [node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))]
        return min(starts) - 1, node.end_lineno or node.lineno

    def cut(self, span: tuple[int, int]) -> str:
        return "\n".join(self.lines[span[0] : span[1]])


_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def python(text: str, s: Settings, count: Counter = estimate, source: str = "") -> list[Piece]:
    """Functions and classes one by one, the statements between them as module text; comments between statements are lost."""
    src = _Source(text)
    head = f"# {s.labels['file']}: {source}\n" if source else ""
    out: list[Piece] = []
    loose: list[str] = []

    def unit(content: str, kind: str, name: str | None = None, **more) -> Piece:
        extra = {"language": "python", "kind": kind} | ({"qualname": name} if name else {})
        return Piece(head + content, "code_unit", extra=extra, **more)

    def module() -> None:
        body = "\n".join(loose).strip("\n")
        loose.clear()
        if body.strip():
            out.extend(unit(p, "module") for p in split_text(body, s.chunk_max_tokens, s.chunk_overlap_tokens))

    for node in ast.parse(text).body:
        if not isinstance(node, (*_FUNCTION, ast.ClassDef)):
            loose.append(src.cut(src.span(node)))
            continue
        module()
        whole = src.cut(src.span(node))
        if isinstance(node, _FUNCTION):
            out.append(unit(whole, "function", node.name))
        elif count(whole) <= 2 * s.chunk_max_tokens:
            out.append(unit(whole, "class", node.name))
        else:
            parent = len(out)
            out.append(unit(cap(whole, s.parent_max_tokens, s.labels["capped"]), "class", node.name, role="parent", searchable=False))
            methods = [m for m in node.body if isinstance(m, _FUNCTION)]
            taken = {k for m in methods for k in range(*src.span(m))}
            rest = "\n".join(src.lines[k] for k in range(*src.span(node)) if k not in taken).strip("\n")
            if rest.strip():
                out.append(unit(rest, "class_header", node.name, role="child", parent=parent))
            first = src.lines[node.lineno - 1].strip()
            for m in methods:
                out.append(unit(f"# {s.labels['context']}: {first}\n{src.cut(src.span(m))}", "method", f"{node.name}.{m.name}", role="child", parent=parent))
    module()
    if not out:
        raise ChunkingError(f"no code to chunk in {source!r}")
    return out


def _opens(line: str) -> str | None:
    """Name of the unit that a line opens; None if it opens none."""
    for rule in _OPENERS:
        if m := rule.match(line):
            return m[1] or "<anonym>"
    return None


_TOKEN = re.compile(r"//|/\*|\*/|\\.|[{}'\"`]", re.S)


def block_end(lines: list[str], start: int, within: int = 3, most: int = 4000) -> int | None:
    """Line where the block of a signature closes.

    A brace must open within three lines and close within ``most``. Strings
    and comments are skipped; strings other than back-quoted end with the line.
    """
    if not any("{" in x for x in lines[start : start + within]):
        return None
    depth, opened, state = 0, False, ""  # state: "", a quote, or "*"
    for k in range(start, min(len(lines), start + most)):
        at, line = 0, lines[k]
        while m := _TOKEN.search(line, at):
            token, at = m[0], m.end()
            if state == "*":
                if token == "*/":
                    state = ""
                elif len(token) > 1:
                    at = m.start() + 1
            elif state:
                if token == state:
                    state = ""
                elif len(token) > 1 and token[0] != "\\":
                    at = m.start() + 1
            elif token == "//":
                break
            elif token == "/*":
                state = "*"
            elif token in "'\"`":
                state = token
            elif token == "{":
                depth, opened = depth + 1, True
            elif token == "}":
                depth -= 1
                if opened and not depth:
                    return k
            elif len(token) > 1:
                at = m.start() + 1
        if state in ("'", '"'):
            state = ""
    return None


def braces(text: str, s: Settings, count: Counter = estimate, source: str = "") -> list[Piece]:
    """Units in order, then all lines outside of units as module text; raw windows if there is neither."""
    lines = text.split("\n")
    head = f"// {s.labels['file']}: {source}\n" if source else ""

    def units() -> Iterator[tuple[int, int, str]]:
        k = 0
        while k < len(lines):
            name = _opens(lines[k])
            end = block_end(lines, k) if name else None
            if end is not None:
                yield k, end + 1, name
            k = k + 1 if end is None else end + 1

    found = list(units())
    out = [Piece(head + "\n".join(lines[a:b]), "code_unit", extra={"qualname": name, "kind": "unit"}) for a, b, name in found]
    edges = [0, *(x for a, b, _ in found for x in (a, b)), len(lines)]
    between = ["\n".join(lines[a:b]) for a, b in zip(edges[::2], edges[1::2]) if b > a]
    rest = "\n\n".join(x for x in between if x.strip())
    window = lambda t: split_text(t, s.chunk_max_tokens, s.chunk_overlap_tokens)
    if rest.strip():
        out += [Piece(head + p, "code_unit", extra={"kind": "module"}) for p in window(rest)]
    return out or [Piece(head + p, "code_unit", extra={"kind": "raw"}) for p in window(text)]
