"""Text splitting: windows of bounded size along natural boundaries.

Budgets are characters, four a token; only comparisons of token estimates use
the configured counter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

CHARS = 4
#: Boundaries from coarse to fine: blank lines, lines, ends of sentences, white space.
_CUTS = tuple(map(re.compile, (r"\n\n+", r"\n", r"(?<=[;:.!?])\s", r"\s+")))

Counter = Callable[[str], int]


def estimate(text: str) -> int:
    """Tokens by the rule of thumb: a quarter of the code points, rounded up, one at least."""
    return max(1, (len(text) + CHARS - 1) // CHARS)


def pieces_at(text: str, cut: re.Pattern) -> Iterator[str]:
    """Non-empty pieces; each keeps the separator that ends it."""
    at = 0
    for m in cut.finditer(text):
        if m.end() > at:
            yield text[at : m.end()]
            at = m.end()
    if at < len(text):
        yield text[at:]


def atoms(text: str, size: int, level: int = 0) -> Iterator[str]:
    """Pieces of at most ``size`` characters, by the coarsest boundaries that will do."""
    if len(text) <= size:
        yield text
    elif level == len(_CUTS):
        yield from (text[k : k + size] for k in range(0, len(text), size))
    else:
        for piece in pieces_at(text, _CUTS[level]):
            yield from atoms(piece, size, level + 1)


def split_text(text, max_tokens, overlap_tokens=0, min_tokens=1, count: Counter = estimate) -> list[str]:
    """Windows of at most ``max_tokens``; each begins with the tail of the one before.

    A last window under ``min_tokens`` joins the one before, which may then
    exceed the budget.
    """
    text = text.strip()
    size = CHARS * max_tokens
    if len(text) <= size:
        return [text] if text else []
    shared = min(CHARS * overlap_tokens, size // 3)
    out: list[str] = []
    window = ""
    for atom in atoms(text, size):
        if len(window) + len(atom) > size:
            if done := window.strip():
                out.append(done)
            tail = window[len(window) - shared :] if 0 < shared < len(window) else window if shared else ""
            head, blank, rest = tail.partition(" ")
            if blank and rest:
                tail = rest
            window = tail if len(tail) + len(atom) <= size else ""
        window += atom
    if done := window.strip():
        out.append(done)
    if len(out) > 1 and count(out[-1]) < min_tokens:
        out[-2:] = ["\n".join(out[-2:])]
    return out


def cap(text: str, max_tokens: int, mark: str) -> str:
    """The first ``max_tokens``, back to a blank if one lies in the second half, and a mark."""
    size = CHARS * max_tokens
    if len(text) <= size:
        return text
    blank = text.rfind(" ", 0, size)
    return text[: blank if 2 * blank > size and blank > size // 2 else size] + mark


def pack(items: list[str], size: int, first: int, joint: int = 1) -> list[list[str]]:
    """Greedy runs: a new one begins where the running length would exceed ``size``."""
    runs: list[list[str]] = []
    total = 0
    for item in items:
        if not runs or total + len(item) > size and runs[-1]:
            runs.append([])
            total = first
        runs[-1].append(item)
        total += len(item) + joint
    return runs
