"""Call expressions of script files as columns.

A tokenizer returns positions only (``tokens.py``).  Callees, the filter on them, lines, arguments and the verdicts on
first arguments are expressions over the bytes between those positions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tokens
from .text import has_any, let

CALL_TYPE = "array<struct<ord:int,line:int,callee:string,arg0:string,tainted:boolean,glued:boolean,interpolated:boolean>>"


def _ints(names: tuple[str, ...]) -> str:
    return "array<struct<" + ",".join(f"{n}:int" for n in names) + ">>"


_TOKENS = f"struct<calls:{_ints(tokens.CALL)},literals:{_ints(tokens.LITERAL)},lines:array<int>>"


def _rows(names: tuple[str, ...], texts: list[list[list[int]]]) -> pa.Array:
    """Lists of positions per text as an Arrow array of lists of structs."""
    offsets = [0]
    for rows in texts:
        offsets.append(offsets[-1] + len(rows))
    flat = [row for rows in texts for row in rows]
    columns = zip(*flat, strict=True) if flat else [()] * len(names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], list(names)))


@lru_cache(maxsize=1)
def _tokens_udf():
    def of(texts: pa.Array) -> pa.Array:
        calls, literals, lines = [], [], []
        for value in texts:
            text = value.as_py() or ""
            found, spans = tokens.in_bytes(text, *tokens.positions(text))
            calls.append(found)
            literals.append(spans)
            lines.append(tokens.line_ends(text.encode("utf-8", "surrogatepass")) if found else [])
        arrays = [_rows(tokens.CALL, calls), _rows(tokens.LITERAL, literals), pa.array(lines, pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(arrays, ["calls", "literals", "lines"])

    return F.arrow_udf(of, _TOKENS)


# ---- what positions mean ----------------------------------------------------

#: Words that may stand in front of a bracket without being called.
_KEYWORDS = (
    "if for while switch catch return typeof await void delete throw case do else yield in of function async import super".split()
)


def callee_of(raw: Column) -> Column:
    """Dotted name; the part after the last non-null assertion, without ``this`` and private names."""
    name = F.regexp_replace(raw, r"(?U)\s", "")
    name = F.regexp_replace(name, r"^.*!\.", "")
    name = F.regexp_replace(name, r"(?U)^\.|^this\.|#[\w$]+\.?", "")
    return F.when(name == "this", "").otherwise(name)


def _is_called(raw: Column) -> Column:
    first = F.regexp_extract(raw, r"(?U)^[\w$]*", 0)
    return ~raw.contains("?") & ~first.isin(*_KEYWORDS)


def _piece(data: Column, start: Column, stop: Column) -> Column:
    return F.substring(data, start + 1, stop - start).cast("string")


def line_of(at: Column, lines: Column) -> Column:
    """1-based line of a position, by binary search in a file's newline index."""

    def halve(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["low"] + range_["high"], 1)
        behind = F.get(lines, middle) < at
        searching = range_["low"] < range_["high"]
        return F.struct(
            F.when(searching & behind, middle + 1).otherwise(range_["low"]).alias("low"),
            F.when(searching & ~behind, middle).otherwise(range_["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lines) + F.lit(2))).cast("int"))
    whole = F.struct(F.lit(0).alias("low"), F.size(lines).alias("high"))
    return F.aggregate(steps, whole, halve, lambda r: r["low"] + 1)


# An interpolation that is more than a literal.
_NO_LITERAL = r"""(?<!\\)\$\{(?!\s*(?:"[^"]*"|'[^']*'|[\d.]+)\s*\})"""
_OPERAND = (
    r"(?:^|[-+*/%(])\s*(?!(?:await|new|typeof|void|delete|true|false|null|function|async|class|this)(?![\w$.\p{L}\p{N}]))[\p{L}_$]"
)
_ARITHMETIC = r'^[\w\p{L}\p{N}$.\s+\-*/%"`!]*\z'
_LAST_PLUS = r'[\w\p{L}\p{N}$"`)]\s*\+\s*[^+\s][^+\-]*\z'
# Brackets that call or index stand behind a name, or behind a bracket that closed.  Groups and lists that are done with
# are marked, so that the brackets around them become innermost.
_BEHIND = r"[\w\p{L}\p{N}$)\]\x02\x04\x05] ?"
_INDEXED = rf"(?<={_BEHIND})(?:\([^()\[\]]*\)|\[[^()\[\]]*\])"
_GROUP = rf"(?<!{_BEHIND})\(([^()\[\]]*)\)"
_LIST = rf"(?<!{_BEHIND})\[([^()\[\]]*)\]"


def _deepest(text: Column) -> Column:
    """The most brackets open at once."""
    brackets = F.split(F.regexp_replace(text, r"[^()\[\]]", ""), "")

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _concatenates(plain: Column) -> Column:
    """Whether a text without literals adds up something variable, in sums that stand in no call."""

    def peel(state: Column, _: Column) -> Column:
        flat = F.regexp_replace(state["flat"], _INDEXED, "")
        flat = F.regexp_replace(F.regexp_replace(flat, _GROUP, "\x01$1\x02"), _LIST, "\x03$1\x04")
        top = F.regexp_replace(state["top"], _INDEXED, "")
        top = F.regexp_replace(F.regexp_replace(top, _GROUP, "\x05"), _LIST, "\x03$1\x04")
        return F.struct(flat.alias("flat"), top.alias("top"))

    def judge(state: Column) -> Column:
        flat = F.translate(state["flat"], "\x01\x02\x03\x04", "()[]")
        top = F.replace(F.translate(state["top"], "\x03\x04", "[]"), F.lit("\x05"), F.lit('""'))
        return ~top.rlike(r"[()]") & top.rlike(_ARITHMETIC) & top.rlike(_LAST_PLUS) & flat.rlike(_OPERAND)

    spaced = F.regexp_replace(F.translate(plain, "\x01\x02\x03\x04\x05", ""), r"(?U)\s+", " ")

    def peeled(text: Column) -> Column:
        rounds = _deepest(text)
        start = F.struct(text.alias("flat"), text.alias("top"))
        return F.when(rounds == 0, judge(start)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, peel, judge))

    return let(spaced, peeled)


def _verdicts(data: Column, begin: Column, end: Column, spans: Column) -> Column:
    """``arg0, tainted, glued, interpolated`` of the argument from ``begin`` to ``end``, whose outermost literals are ``spans``."""

    def judge(arg: Column) -> Column:
        first, tick = F.get(spans, F.lit(0)), F.lit("`")
        begins = F.coalesce(first["start"] == begin, F.lit(False))
        template = begins & (first["stop"] == end) & arg.startswith(tick)
        rest = F.ltrim(F.regexp_replace(_piece(data, first["stop"], end), r"(?U)^\s+", ""))
        # the text between literals, each of which becomes an empty one of its kind
        between = F.transform(
            spans,
            lambda s, i: F.concat(
                _piece(data, F.when(i == 0, begin).otherwise(F.get(spans, i - 1)["stop"]), s["start"]),
                F.when(_piece(data, s["start"], s["start"] + 1) == tick, "``").otherwise('""'),
            ),
        )
        tail = _piece(data, F.when(F.size(spans) == 0, begin).otherwise(F.get(spans, F.size(spans) - 1)["stop"]), end)
        plain = F.concat(F.array_join(between, ""), tail)
        interpolated = template & arg.contains("${")
        added = F.when(arg.contains("+"), _concatenates(plain)).otherwise(False)
        return F.struct(
            arg.alias("arg0"),
            F.when(template, arg.rlike(_NO_LITERAL)).otherwise(added).alias("tainted"),
            (interpolated | (begins & ~arg.startswith(tick) & rest.startswith("+"))).alias("glued"),
            interpolated.alias("interpolated"),
        )

    return let(_piece(data, begin, end), judge)


def _outermost(literals: Column, first: Column, last: Column, level: Column) -> Column:
    return F.filter(F.slice(literals, first + 1, F.greatest(last - first, F.lit(0))), lambda s: s["level"] == level)


def _words(pattern: str) -> list[str]:
    return sorted({w.lower() for w in re.findall(r"[A-Za-z]{3,}", pattern)})


def call_sites(text: Column, names: str | None = None) -> Column:
    """Calls in order as ``array<struct<ord, line, callee, arg0, tainted, glued, interpolated>>``; null for a null text.

    ``names`` keeps only callees that a pattern finds, whatever their case.  Each of its alternatives holds a word, so a
    text without any of its words has no such call and is not walked.
    """
    asked = F.when(has_any(F.lower(text), *_words(names)), text) if names is not None else text

    def named(data: Column, found: Column) -> Column:
        rows = F.transform(found["calls"], lambda c: F.struct(c.alias("c"), _piece(data, c["at"], c["stop"]).alias("raw")))
        called = F.filter(rows, lambda r: _is_called(r["raw"]))
        cleaned = F.transform(called, lambda r: F.struct(r["c"].alias("c"), callee_of(r["raw"]).alias("callee")))
        return F.filter(cleaned, lambda r: r["callee"].rlike(f"(?i){names}")) if names is not None else cleaned

    def described(data: Column, found: Column, rows: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            c = r["c"]
            v = _verdicts(data, c["begin"], c["end"], _outermost(found["literals"], c["first"], c["last"], c["level"]))
            return let(
                v,
                lambda v: F.struct(
                    (i + 1).alias("ord"), line_of(c["at"], found["lines"]).alias("line"), r["callee"].alias("callee"),
                    v["arg0"].alias("arg0"), v["tainted"].alias("tainted"), v["glued"].alias("glued"), v["interpolated"].alias("interpolated"),
                ),
            )

        return F.transform(rows, one)

    def of(file: Column) -> Column:
        return let(named(file["data"], file["found"]), lambda rows: described(file["data"], file["found"], rows))

    file = F.struct(text.cast("binary").alias("data"), _tokens_udf()(asked).alias("found"))
    return F.when(text.isNotNull(), F.coalesce(let(file, of), F.array().cast(CALL_TYPE)))


def tainted_arg(arg: Column) -> Column:
    """A template with a non-literal interpolation, or a ``+`` with a variable part."""

    def of(whole: Column) -> Column:
        spans = F.filter(whole["found"]["literals"], lambda s: s["level"] == 0)
        return _verdicts(whole["data"], F.lit(0), F.octet_length(whole["data"]), spans)["tainted"]

    whole = F.struct(arg.cast("binary").alias("data"), _tokens_udf()(arg).alias("found"))
    return F.when(arg.isNotNull(), let(whole, of))
