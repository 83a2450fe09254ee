"""Positions in script text: calls, literals and line ends, by one walk with a stack of open brackets.

Comments, strings, template texts and regex literals are skipped; what stands in a template's interpolation is code.  A
call is a dotted name, type arguments perhaps, and an argument list that no block follows.  Nesting and length have no
limit.  A backtick whose template does not close is ordinary text: the walk goes back to it and goes on behind it, and
remembers what else was open then, so that it does not go back for each of many.

Only positions come out of here; what they mean is decided by column expressions (``calls.py``).
"""

from __future__ import annotations

import re
from itertools import accumulate

_NAME = r"(?:[^\W\d]|\$)[\w$]*"
# What may matter next: quotes, comments, brackets, commas, and names in front of an argument list.
_NEXT = re.compile(rf"[\"'`/(){{}}\[\],]|(?<![\w$])(?:\??\.\s*)?{_NAME}(?:\s*[?!]?\.\s*#?{_NAME})*(?=\s*[(<])")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.DOTALL)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
_SPACE = re.compile(r"\s*")
_NOT_CALLED = re.compile(r"(?:new\s+|function\s*\*?\s*)\Z")
_BEFORE_REGEX = frozenset("=(,:!&|?;{}[\n")
# Angles, brackets, and what does not occur between the angles of type arguments.
_IN_TYPES = re.compile(r"[<>()\[\]{};+*/%^~!@#`]|&&|\|\|")
_CLOSES = {")": "(", "]": "[", "}": "{"}

#: Of a call: its name, its first argument without white space around it, the templates around it, its literals' places.
CALL = ("at", "stop", "begin", "end", "level", "first", "last")
#: Of a literal: its ends, and the templates around it.
LITERAL = ("start", "stop", "level")


def _type_ends(text: str) -> dict[int, int]:
    """Ends of balanced type arguments by the position of their first angle, of the whole text at once."""
    ends: dict[int, int] = {}
    angles: list[tuple[int, int]] = []  # position and depth in brackets of open angles
    depth = 0
    last: dict[int, int] = {}  # by depth: where it was last left, or held what no type holds
    for m in _IN_TYPES.finditer(text):
        i, c = m.start(), m.group()
        if c == "<":
            angles.append((i, depth))
        elif c == ">":
            if angles and text[i - 1] != "=":
                at, outside = angles.pop()
                if depth == outside and last.get(depth, -1) < at:
                    ends[at] = i + 1
        elif c in "([{":
            depth += 1
        else:
            last[depth] = i
            if c in ")]}":
                depth -= 1
    return ends


def _is_regex(text: str, at: int) -> bool:
    i = at - 1
    while i >= 0 and at - i <= 5 and text[i] in " \t\r":
        i -= 1
    return i >= 0 and text[i] in _BEFORE_REGEX


def positions(text: str) -> tuple[list[list[int]], list[list[int]]]:
    """Calls (``CALL``) in the order of their names, and literals (``LITERAL``) in order; no optional calls (``a?.b()``)."""
    calls: list[list] = []  # as CALL, and whether it counts
    literals: list[list[int]] = []
    stack: list[tuple[str, int]] = []  # bracket and the call it opens, or its position
    ticks: list[tuple[int, int, int]] = []  # of open templates: place in ``stack``, calls and literals before
    unclosed: set[int] = set()  # backticks that close nothing
    endless: set[int] = set()  # where code begins whose brace is never closed
    type_ends: dict[int, int] | None = None
    last_tick = text.rfind("`")
    i, n = 0, len(text)
    runs_out = n  # template text from here on has no end

    def template(at: int) -> int:
        """Walk on in a template's text: behind it, or behind the next ``${``; the end if it does not close."""
        nonlocal runs_out
        if at >= runs_out:
            return n
        begin, at = at, _TEMPLATE_TEXT.match(text, at).end()
        if at >= n or text[at] == "\\":
            runs_out = begin
            return n
        if text[at] == "`":
            stack.pop()
            literals[ticks.pop()[2]][1] = at + 1
            return at + 1
        stack.append(("${", at))
        return n if at + 2 in endless else at + 2

    def end_argument(call: int, at: int) -> None:
        if call >= 0 and calls[call][3] < 0:
            calls[call][3], calls[call][6] = at, len(literals)

    while True:
        m = _NEXT.search(text, i) if i < n else None
        if not m:
            if not ticks:
                break
            place, before, spans = ticks[0]
            i = stack[place][1] + 1
            for kind, at in stack[place:]:
                if kind == "`":
                    unclosed.add(at)
                elif kind in ("${", "{"):
                    endless.add(at + len(kind))
            del stack[place:], calls[before:], literals[spans:], ticks[:]
            continue
        at, c = m.start(), text[m.start()]
        i = at + 1
        if c in "\"'":
            s = _STRING.match(text, at)
            if s:
                i = s.end()
                literals.append([at, i, len(ticks)])
        elif c == "/":
            s = _COMMENT.match(text, at) or (_REGEX.match(text, at) if _is_regex(text, at) else None)
            i = s.end() if s else i
        elif c == "`":
            if at in unclosed:
                i = n if ticks else i  # what holds it does not close either
            elif at != last_tick:
                ticks.append((len(stack), len(calls), len(literals)))
                literals.append([at, n, len(ticks) - 1])
                stack.append(("`", at))
                i = template(i)
        elif c in "([{":
            stack.append((c, at if c == "{" else -1))
        elif c == ",":
            if stack and stack[-1][0] == "(":
                end_argument(stack[-1][1], at)
        elif c in ")]}":
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] not in (_CLOSES[c], "${", "`"):
                depth -= 1
            if depth < 0 or stack[depth][0] == "`":
                continue
            if stack[depth][0] == "${":
                if c == "}":
                    del stack[depth:]
                    i = template(i)
                continue
            for kind, call in stack[depth:]:
                end_argument(call if kind == "(" else -1, at)
            kind, call = stack[depth]
            del stack[depth:]
            if kind == "(" and call >= 0:
                brace = _SPACE.match(text, i).end()
                calls[call][7] = text[brace : brace + 1] != "{"
        else:
            i = m.end()
            begin = _SPACE.match(text, i).end()
            if text[begin] == "<":
                type_ends = _type_ends(text) if type_ends is None else type_ends
                types = type_ends.get(begin, -1)
                begin = _SPACE.match(text, types).end() if types > 0 else -1
                if begin < 0 or begin >= n or text[begin] != "(":
                    continue
            if not _NOT_CALLED.search(text, max(0, at - 40), at):
                stack.append(("(", len(calls)))
                calls.append([at, m.end(), begin + 1, -1, len(ticks), len(literals), 0, True])
            else:
                stack.append(("(", -1))
            i = begin + 1
    for kind, call in stack:
        if kind == "(":
            end_argument(call, n)
    kept = [call[:7] for call in calls if call[7]]
    for call in kept:
        call[2] = min(_SPACE.match(text, call[2]).end(), call[3])
        while call[3] > call[2] and text[call[3] - 1].isspace():
            call[3] -= 1
    return kept, literals


def in_bytes(text: str, calls: list[list[int]], literals: list[list[int]]) -> tuple[list[list[int]], list[list[int]]]:
    """The same positions, counted in bytes of UTF-8."""
    if text.isascii():
        return calls, literals
    at = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
    return [[*map(at.__getitem__, c[:4]), *c[4:]] for c in calls], [[at[s], at[e], level] for s, e, level in literals]


def line_ends(data: bytes) -> list[int]:
    """The newline index of a file: where its line feeds stand, in bytes."""
    ends, at = [], data.find(b"\n")
    while at >= 0:
        ends.append(at)
        at = data.find(b"\n", at + 1)
    return ends
