"""Query expansion by a pluggable language model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from ..functions.retry import retry

Complete = Callable[[str], str]
_BULLET = re.compile(r"\s*(?:\d+[.)]|[-*•])?\s*")


def parse_list(reply: str) -> list[str]:
    """Strings of a JSON list, of the first bracketed part that is one, or of the lines without bullets (longer than two)."""
    reply = reply.strip()
    for text in (reply, *(m[0] for m in [re.search(r"\[.*\]", reply, re.S)] if m)):
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            continue
        if isinstance(value, list):
            return [s for s in (str(x).strip() for x in value) if s]
    lines = (line[_BULLET.match(line).end() :].strip().strip("\"'") for line in reply.splitlines())
    return [x for x in lines if len(x) > 2]


def distinct_variants(query: str, found: list[str], most: int) -> list[str]:
    """The first ``most`` that differ, case folded and stripped, from the query and each other."""
    seen, out = {query.strip().casefold()}, []
    for v in found:
        key = v.strip().casefold()
        if key and key not in seen:
            seen.add(key)
            out.append(v.strip())
    return out[:most]


def expand(query: str, complete: Complete, most: int = 3) -> list[str]:
    """Variants of a query; passing failures are tried again, and whatever fails then, there are none."""
    prompt = f"Give {most} other wordings of this search query as a JSON list of strings.\nQuery: {query}"
    try:
        return distinct_variants(query, parse_list(retry(lambda: complete(prompt))), most)
    except Exception:
        return []
