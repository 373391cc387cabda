"""Rewrites of expression text between SQL dialects, string literals left alone."""

from __future__ import annotations

import re

PIECES = re.compile(r"('(?:[^']|'')*')|([^']+)")


def outside_strings(text: str, change) -> str:
    """``change`` applied to what is not in single quotes."""
    return "".join(m[1] if m[1] else change(m[2]) for m in PIECES.finditer(text))


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand outside brackets and strings."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and text[i : i + len(mark)].lower() == mark.lower() and (not mark.isalpha() or _is_word(text, i, len(mark))):
            out.append(text[start:i].strip())
            i += len(mark)
            start = i
            continue
        i += 1
    return [*out, text[start:].strip()]


def _is_word(text: str, at: int, n: int) -> bool:
    return (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")) and (at + n >= len(text) or not (text[at + n].isalnum() or text[at + n] == "_"))


def closing(text: str, at: int) -> int:
    """Position of the bracket that closes the one at ``at``."""
    pairs, depth, quote = {"(": ")", "[": "]", "{": "}"}, 0, ""
    opened, closed = text[at], pairs[text[at]]
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c == "'":
            quote = c
        elif c == opened:
            depth += 1
        elif c == closed:
            depth -= 1
            if not depth:
                return i
    raise ValueError(f"missing {closed}")
