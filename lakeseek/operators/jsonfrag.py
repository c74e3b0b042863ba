"""Chunker for JSON and NDJSON: fragments of bounded size with their paths."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from ..config import Settings
from ..errors import ChunkingError
from .split import CHARS, Counter, cap, estimate, split_text
from .structured import Piece


def parse(text: str, source: str = "") -> Any:
    """One JSON value, or one a line; broken lines are skipped up to a fifth of the good ones, one at least."""
    try:
        return json.loads(text)
    except json.JSONDecodeError as whole:
        good, bad = [], 0
        for line in filter(str.strip, text.splitlines()):
            try:
                good.append(json.loads(line))
            except json.JSONDecodeError:
                bad += 1
        if not good or bad > max(1, len(good) // 5):
            raise ChunkingError(f"{source!r} is neither JSON nor NDJSON: {whole}") from whole
        return good


def _text(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def fragments(path: str, value: Any, s: Settings) -> Iterator[tuple[str, str]]:
    """(path, text) of parts that fit: groups of keys, slices of arrays, parts of long scalars."""
    size = CHARS * s.chunk_max_tokens
    whole = _text(value)
    if len(whole) <= size:
        yield path, whole
        return
    if isinstance(value, dict):
        group: dict = {}
        used = 2
        for key, item in value.items():
            n = len(_text({key: item}))
            if group and (n > size or used + n > size):
                yield f"{path}.{{{','.join(group)}}}", _text(group)
                group, used = {}, 2
            if n > size:
                yield from fragments(f"{path}.{key}", item, s)
            else:
                group[key] = item
                used += n
        if group:
            yield f"{path}.{{{','.join(group)}}}", _text(group)
    elif isinstance(value, list):
        first, used = 0, 2
        for k, item in enumerate(value):
            n = len(_text(item))
            if k > first and (n > size or used + n > size):
                yield f"{path}[{first}:{k}]", _text(value[first:k])
                first, used = k, 2
            if n > size:
                yield from fragments(f"{path}[{k}]", item, s)
                first, used = k + 1, 2
            else:
                used += n + 2
        if first < len(value):
            yield f"{path}[{first}:{len(value)}]", _text(value[first:])
    else:
        parts = split_text(str(value), s.chunk_max_tokens, s.chunk_overlap_tokens)
        for k, part in enumerate(parts, 1):
            yield f"{path} ({s.labels['part']} {k}/{len(parts)})", part


def shape(value: Any, depth: int = 0, keys: int = 60) -> str:
    """Keys and type names, two levels deep."""
    pad = depth * "  "
    nested = depth < 2
    if isinstance(value, dict):
        rows = []
        for key in list(value)[:keys]:
            item = value[key]
            rows += [f"{pad}{key}:", shape(item, depth + 1)] if nested and isinstance(item, (list, dict)) else [f"{pad}{key}: {type(item).__name__}"]
        more = len(value) - keys
        return "\n".join([*rows, *([f"{pad}… ({more} weitere Schlüssel)"] if more > 0 else [])])
    if isinstance(value, list):
        kind = "leer" if not value else type(value[0]).__name__
        line = f"{pad}Array mit {len(value)} Elementen (Typ: {kind})"
        return f"{line}\n{shape(value[0], depth + 1)}" if nested and kind == "dict" else line
    return pad + type(value).__name__


def json_fragments(text: str, s: Settings, count: Counter = estimate, source: str = "") -> list[Piece]:
    """Fragments; more than one hang on a parent that tells the shape."""
    value = parse(text, source)
    found = list(fragments("$", value, s))
    if not found:
        raise ChunkingError(f"{source!r} has no JSON fragment")
    label = s.labels
    out = []
    if len(found) > 1:
        name = f" '{source}'" if source else ""
        out.append(Piece(cap(f"{label['json_doc']}{name} – {label['json_shape']}:\n{shape(value)}", s.parent_max_tokens, label["capped"]), "section", "parent", extra={"json_path": "$"}, searchable=False))
    parent = 0 if out else None
    out += [Piece(f"{label['json_path']}: {p}\n{body}", "json_fragment", "standalone" if parent is None else "child", parent, extra={"json_path": p}) for p, body in found]
    return out
