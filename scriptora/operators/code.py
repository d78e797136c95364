"""Cutting code that is too long: at definitions, else at declarations, else at blank lines."""

from __future__ import annotations

import re

_NAME, _ASYNC, _EXPORT = r"\s+\w+", r"(?:async\s+)?", r"(?:export\s+)?"
_DECLARATION = re.compile(
    "|".join(
        (
            "class" + _NAME,
            _ASYNC + "def" + _NAME,
            r"(?:pub\s+)?(?:fn|func|struct|type)" + _NAME,
            _EXPORT + _ASYNC + "function" + _NAME,
            _EXPORT + "(?:const|let|var)" + _NAME + r"\s*=\s*" + _ASYNC + r"\(",
        )
    )
)


def _cut(lines: list[str], starts: list[int]) -> list[str]:
    parts = ["\n".join(lines[a:b]).rstrip() for a, b in zip(starts, [*starts[1:], len(lines)])]
    return [p for p in parts if p.strip()]


def _fit(parts: list[str], most: int, count) -> list[str]:
    return parts if count is None else [x for p in parts for x in ([p] if count(p) <= most else at_blank_lines(p, most, count))]


def at_definitions(code: str, most: int, count=None) -> list[str]:
    """Python's top-level functions and classes, what comes before first; nothing unless that gives several parts."""
    import ast

    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError):
        return []
    starts = [n.lineno - 1 for n in body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
    if not starts:
        return []
    lines = code.split("\n")
    parts = _fit(_cut(lines, ([0] if starts[0] else []) + starts), most, count)
    return parts if len(parts) > 1 else []


def at_declarations(code: str, most: int, count=None) -> list[str]:
    lines = code.split("\n")
    starts = [0] + [i for i, x in enumerate(lines) if i and _DECLARATION.match(x)]
    return _fit(_cut(lines, starts), most, count) if len(starts) > 1 else []


def at_blank_lines(code: str, most: int, count=None) -> list[str]:
    """Blocks packed greedily under the limit."""
    blocks = [b for b in re.split(r"\n\n+", code) if b.strip()]
    if not blocks or count is None:
        return blocks or [code]
    out = [blocks[0]]
    for b in blocks[1:]:
        joined = f"{out[-1]}\n\n{b}"
        if count(joined) > most:
            out.append(b)
        else:
            out[-1] = joined
    return out


def split_code(code: str, language: str = "", most: int = 256, count=None) -> list[str]:
    fits = count is not None and count(code) <= most
    if fits or not code.strip():
        return [code] if code.strip() else []
    if language.lower() in ("", "py", "python"):
        parts = at_definitions(code, most, count)
        if parts:
            return parts
    parts = at_declarations(code, most, count)
    return parts if len(parts) > 1 else at_blank_lines(code, most, count)
