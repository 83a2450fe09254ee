"""Render one pattern catalogue for the regex dialects it has to run in.

Patterns are written once in the ECMAScript dialect (flags ``i`` and ``m`` only).
``to_java`` keeps that meaning on the JVM, where ``\\b`` is Unicode aware, ``$``
also matches before a final newline and ``\\s`` is ASCII only; ``to_re2`` does the
same for RE2 engines, which the SQL oracles run on (lookarounds excluded).
"""

from __future__ import annotations

_SPACE = {
    "java": r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff",
    "re2": r"\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}",
}
_EOL = {"java": r"\n\r\u2028\u2029", "re2": r"\n\r\x{2028}\x{2029}"}
_BOUNDARY = {
    "java": r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
    "re2": r"\b",
}
_LINE_START = {"java": r"(?:^|(?<=[\n\r\u2028\u2029]))", "re2": r"(?m:^)"}
_LINE_END = {"java": r"(?:\z|(?=[\n\r\u2028\u2029]))", "re2": r"(?m:$)"}


def _boundary(following: str, target: str) -> str:
    """``\\b``; a single lookbehind where a word character must follow."""
    if target == "java" and _starts_with_word(following):
        return "(?<![A-Za-z0-9_])"
    return _BOUNDARY[target]


def _class_end(src: str, start: int) -> int:
    i = start + 1
    while src[i] != "]":
        i += 2 if src[i] == "\\" else 1
    return i


def _group_end(src: str, start: int) -> int:
    """Index of the bracket closing the group opened at ``start``."""
    depth, i = 0, start
    while True:
        ch = src[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            i = _class_end(src, i)
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1


def _starts_with_word(src: str) -> bool:
    """True if whatever matches ``src`` surely starts with a word character."""
    if src[:1].isalnum() or src[:1] == "_":
        return src[1:2] not in ("?", "*", "{")
    if src.startswith("\\w"):
        return src[2:3] not in ("?", "*", "{")
    if src.startswith("("):
        end = _group_end(src, 0)
        body = src[3:end] if src.startswith("(?:") else src[1:end]
        if src[end + 1 : end + 2] in ("?", "*", "{") or body.startswith("?"):
            return False
        return all(_starts_with_word(alt) for alt in _alternatives(body))
    return False


def _alternatives(body: str) -> list[str]:
    out, start, i = [], 0, 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            i = _class_end(body, i)
        elif ch == "(":
            i = _group_end(body, i)
        elif ch == "|":
            out.append(body[start:i])
            start = i + 1
        i += 1
    return out + [body[start:]]


def _render(src: str, flags: str, target: str) -> str:
    out = ["(?i)"] if "i" in flags else []
    multiline = "m" in flags
    i = 0
    while i < len(src):
        ch = src[i]
        if ch == "\\":
            nxt = src[i + 1]
            out.append(
                {
                    "b": _boundary(src[i + 2 :], target),
                    "s": f"[{_SPACE[target]}]",
                    "S": f"[^{_SPACE[target]}]",
                    "/": "/",
                }.get(nxt, ch + nxt)
            )
            i += 2
        elif ch == "[":
            end = _class_end(src, i)
            body = src[i + 1 : end]
            if body != r"\s\S":
                body = body.replace(r"\s", _SPACE[target]).replace("[", r"\[")
            out.append(f"[{body}]")
            i = end + 1
        elif ch == ".":
            out.append(f"[^{_EOL[target]}]")
            i += 1
        elif ch == "^":
            out.append(_LINE_START[target] if multiline else "^")
            i += 1
        elif ch == "$":
            out.append(_LINE_END[target] if multiline else r"\z")
            i += 1
        else:
            out.append(ch)
            i += 1
    return "".join(out)


class Pattern:
    """An ECMAScript pattern with its Java and RE2 renderings."""

    def __init__(self, source: str, flags: str = ""):
        self.source = source
        self.flags = flags
        self.java = _render(source, flags, "java")
        self.re2 = _render(source, flags, "re2")

    def __repr__(self) -> str:
        return f"Pattern({self.source!r}, {self.flags!r})"
