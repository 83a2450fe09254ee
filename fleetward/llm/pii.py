"""Personal data by weak supervision.

Base spans are exact: an e-mail address, an IP address, a card number or a phone number by its pattern and its check
(parts up to 255, Luhn's sum, 9 to 15 digits), leftmost and without overlap within a kind.  They always stay.

Candidates are all base spans and whatever one of the three sources below proposes; labelers of the same sources vote on
every candidate, for, against, or not at all:

* regex: grouped digits with a phone's or a card's lengths but no plus or a wrong sum, dotted numbers with a part out of
  range, addresses of eight hexadecimal groups, forms with ``(at)``, ``[dot]`` or ``[.]``; votes on the base pattern, on a
  strict shape of the kind once such forms are undone, and on whether the neighbours cut a longer token,
* gazetteer: ``name at host dot com`` with a known top-level domain, digits that begin with a calling code after ``00``;
  votes on top-level domains, address blocks in public use, issuer ranges of cards with their lengths, calling codes, and
  the trunk and area prefixes of national numbers,
* context: 7 to 15 digits after a word for a telephone; votes on words before and after that speak for the kind, or for a
  version, an order or a page number.

Every document's votes are counted by pattern of votes, which are few; expectation-maximisation over these counts
estimates how reliable each labeler is and how likely each pattern is personal data.  A logistic classifier trained on
these likelihoods, with the votes and the span's length as features, decides which candidates are added as spans.

Defined results: a null text counts as empty and has no span; rows that repeat an id are read one by one; an empty
table gives an empty result; other columns are not read; a text of any length is read whole, in time that grows with it.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters of context on either side of a candidate.
CONTEXT = 40
#: Iterations of expectation-maximisation; likelihood from which a candidate is added.
ITERATIONS, ADD = 60, 0.9
#: Bounds of a labeler's reliability.
RELIABLE = (0.55, 0.95)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a pattern that begins with a set of characters is searched many times faster than one that begins by looking behind
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_AT = re.compile(r"\s{0,2}[\[({]\s{0,2}at\s{0,2}[\])}]\s{0,2}", re.IGNORECASE)
_DOT = r"\s{0,2}(?:\.|[\[({]\s{0,2}dot\s{0,2}[\])}])\s{0,2}"
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){1,5}", re.IGNORECASE)
_SPOKEN = re.compile(r"\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,5}", re.IGNORECASE)
_PARTED = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]{3}(?:[./_][0-9]{4}){3}(?![0-9])")
_DEFANGED = re.compile(r"[0-9](?<![0-9][0-9])[0-9]{0,2}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_COLONS, _HEX = re.compile(r":[0-9A-Fa-f]{0,4}+:"), re.compile(r"[0-9A-Fa-f:]+")
_RUN = re.compile(r"[(0-9](?<![0-9+][(0-9])(?:(?<=[0-9])|[0-9])(?:[\x20()./-]{0,2}[0-9]){6,}+")
_GROUPS = re.compile(r"[(0-9](?<![0-9+][(0-9])(?<![0-9][.-][(0-9])(?:(?<=[0-9])[0-9]{1,3}|(?<=\()[0-9]{2,4})\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![.-]?[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each ``@``: all of the name's characters before it that no earlier address took."""
    found, taken = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            taken = m.end()
    return found


def _in_range(number: str) -> bool:
    return len(number.lstrip("0")) <= 3 and int(number) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    spans = {"email": _emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(map(_in_range, m.group().split("."))):
            spans["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans["phone"].append(m.span())
    return spans


def _name_before(text: str, at: int) -> int:
    """Where the name of an address that ends at ``at`` starts, at most 64 characters before."""
    start = at
    while start and start > at - 64 and text[start - 1] in _LOCAL:
        start -= 1
    return start


def _sixes(text: str) -> Iterator[tuple[int, int]]:
    """Addresses of hexadecimal groups, by the first two colons with at most one group between them."""
    end = 0
    for m in _COLONS.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start > max(end, m.start() - 4) and text[start - 1] in string.hexdigits:
            start -= 1
        end = _HEX.match(text, start).end()
        if _six(text[start:end]):
            yield start, end


def _six(span: str) -> ipaddress.IPv6Address | None:
    """The address, if it has three groups at least and a digit."""
    if sum(map(bool, span.split(":"))) < 3 or not any(c.isdigit() for c in span):
        return None
    try:
        return ipaddress.IPv6Address(span)
    except ValueError:
        return None


def _by_shape(text: str) -> Iterator[tuple[str, int, int]]:
    """Looser shapes, base spans among them or not."""
    bracketed = "(" in text or "[" in text or "{" in text
    for m in _AT.finditer(text) if bracketed else ():
        start, host = _name_before(text, m.start()), _HOST.match(text, m.end())
        if host and start < m.start():
            yield "email", start, host.end()
    for m in _IP.finditer(text):
        yield "ip", *m.span()
    for m in _DEFANGED.finditer(text) if bracketed or " dot " in text else ():
        yield "ip", *m.span()
    for span in _sixes(text):
        yield "ip", *span
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(_NOT_DIGIT.sub("", m.group())) <= 19:
            yield "card", *m.span()
    for m in _PARTED.finditer(text):
        yield "card", *m.span()
    for m in _GROUPS.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 12:
            yield "phone", *m.span()


def _by_lists(text: str) -> Iterator[tuple[str, int, int]]:
    """What a gazetteer proposes: addresses spelled out, numbers dialled from abroad or after a word for a telephone."""
    for m in _SPOKEN.finditer(text) if " dot " in text.lower() else ():
        start = _name_before(text, m.start())
        if start < m.start() and m.group().rsplit(" ", 1)[1].lower() in _TOP:
            yield "email", start, m.end()
    for m in _RUN.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 7 <= len(digits) <= 15 and (_abroad(digits) or _CALLED.search(text, max(0, m.start() - NAMED), m.start())):
            yield "phone", *m.span()


def candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, base) in order of kind and start; looser ones do not overlap base spans of any kind."""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    extra: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, start, end in sorted({*_by_shape(text), *_by_lists(text)}, key=lambda c: (c[1], -c[2])):
        i = bisect_left(starts, end)
        if (not i or ends[i - 1] <= start) and (not extra[kind] or extra[kind][-1][1] <= start):
            extra[kind].append((start, end))
    for kind in KINDS:
        for start, end, is_base in sorted([(*s, True) for s in base[kind]] + [(*s, False) for s in extra[kind]]):
            yield kind, start, end, is_base


# labelers: 1 for, -1 against, 0 no vote

#: Generic top-level domains, and those of countries.
_TOP = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev cloud online shop site store tech xyz "
    "ac ad ae af ag al am ar at au az ba bd be bg bh bo br by ca cc ch ci cl cm cn co cr cu cy cz de dk do dz ec ee eg es eu fi fr "
    "ge gh gr gt hk hn hr hu id ie il in iq ir is it jm jo jp ke kg kh kr kw kz lb li lk lt lu lv ly ma mc md me mk mn mt mx my mz "
    "ng ni nl no np nz om pa pe ph pk pl pr pt py qa ro rs ru sa se sg si sk sn sv sy th tn tr tv tw tz ua ug uk us uy uz ve vn ye "
    "za zm zw".split()
)
#: Calling codes of one and two digits, and the first two digits of those of three.
_CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
_CALLING_THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Issuers of cards: first and last prefix, shortest and longest number.
_ISSUERS = (
    (4, 4, 13, 19), (51, 55, 16, 16), (2221, 2720, 16, 16), (34, 34, 15, 15), (37, 37, 15, 15), (300, 305, 14, 19), (36, 36, 14, 19),
    (38, 39, 14, 19), (6011, 6011, 16, 19), (644, 659, 16, 19), (3528, 3589, 16, 19), (62, 62, 16, 19), (50, 50, 12, 19), (56, 58, 12, 19),
)
_FOR = {
    "email": re.compile(r"e-?mail|mail|contact|write|reply|correo|courriel|schreib|@", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server|login|client|adresse|servidor|serveur", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|credit|payment|karte|carte|tarjeta|cvv", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel\b|tel[.:]|mobile|fax|anruf|téléphone|teléfono", re.IGNORECASE),
}
#: Words that name a telephone number, and the characters before digits in which one of them has to stand.
_CALLED = re.compile(r"phone|\btel\b|\bcall|mobile|\bcell\b|\bfax|anruf|telefon|handy|téléphone|portable|teléfono|móvil", re.IGNORECASE)
NAMED = 24
_AGAINST = re.compile(r"version|\bv\.?$|order|invoice|page|isbn|serial|build|chapter|section|kapitel|numéro|número", re.IGNORECASE)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-]|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")


def _calling(digits: str) -> bool:
    return digits[:1] in _CALLING or digits[:2] in _CALLING or digits[:2] in _CALLING_THREE


def _abroad(digits: str) -> bool:
    return len(digits) >= 11 and digits.startswith("00") and _calling(digits[2:])


def undone(kind: str, span: str) -> str:
    """The span with spelled-out and bracketed separators in their plain form."""
    if kind == "email":
        span = re.sub(r"\x20at\x20", "@", _AT.sub("@", span), count=1, flags=re.IGNORECASE)
        return re.sub(_DOT + r"|\x20dot\x20", ".", span, flags=re.IGNORECASE)
    if kind == "ip" and ":" not in span:
        return ".".join(re.findall("[0-9]+", span))
    return span


def _strict(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}", span) else -1
    if kind == "ip":
        return 1 if ":" in span or all(_in_range(p) and str(int(p)) == p for p in span.split(".")) else -1
    if kind == "card":
        return 1 if len(digits) in (15, 16) and len(set(digits)) > 2 and luhn(digits) else -1
    return 1 if len(digits) >= 7 and len(set(digits)) > 2 and not _DATE.match(span) else -1


def _known(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return 1 if span.rsplit(".", 1)[-1].lower() in _TOP else 0
    if kind == "ip" and ":" in span:
        six = _six(span)
        return 1 if six.is_global or six.is_private or six.is_link_local else -1
    if kind == "ip":
        first = span.split(".")[0]
        return 1 if _in_range(first) and 1 <= int(first) <= 223 else -1
    if kind == "card":
        issued = (low <= int(digits[: len(str(low))]) <= high and short <= len(digits) <= long for low, high, short, long in _ISSUERS)
        return 1 if any(issued) else -1
    if span[0] == "+":
        return 1 if _calling(digits) else 0
    area = len(digits) == 10 and digits[0] > "1" and digits[3] > "1"
    return 1 if area or _abroad(digits) or digits[0] == "0" < digits[1] else 0


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The votes of all labelers, and the span's length in steps of eight characters."""
    span = undone(kind, text[start:end])
    digits = _NOT_DIGIT.sub("", span)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    cut = (before[-1:].isalnum() or before[-1:] in ("_", ".", "-")) + (after[:1].isalnum() or after[:1] == "_")
    context = 1 if _FOR[kind].search(before) or _FOR[kind].search(after) else 0
    against = -1 if _AGAINST.search(before) else 0
    return (1 if base else -1, _strict(kind, span, digits), 1 if not cut else -1, _known(kind, span, digits), context, against, min(5, (end - start) // 8))


LABELERS = 6


@dataclass
class Model:
    """Per kind: how likely each pattern of votes is personal data."""

    likely: dict[str, dict[tuple[int, ...], float]] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)

    def score(self, kind: str, pattern: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        z = float(np.dot(w, _features(pattern)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(pattern: tuple[int, ...]) -> np.ndarray:
    """A constant, a for and an against indicator of each labeler, and the length."""
    out = [1.0]
    for v in pattern[:LABELERS]:
        out += [float(v > 0), float(v < 0)]
    return np.array([*out, pattern[LABELERS] / 5])


def estimate(counts: dict[tuple[int, ...], int], iterations: int = ITERATIONS) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over patterns of votes.

    A labeler that votes is right with a probability of its own, within ``RELIABLE``: better than chance, never certain,
    so that no two labelers can turn the classes round.  Not voting says nothing.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([p[:LABELERS] for p in patterns], float)
    given = vote != 0
    right, share = np.full(LABELERS, 0.75), 0.5
    likely = np.full(len(patterns), 0.5)
    for _ in range(iterations):
        z = math.log(share / (1 - share)) + vote @ np.log(right / (1 - right))
        before, likely = likely, 1 / (1 + np.exp(-z))
        agree = np.where(vote > 0, likely[:, None], 1 - likely[:, None]) * given
        right = np.clip((n @ agree + 1) / (n @ given + 4 / 3), *RELIABLE)
        share = float(np.clip((n @ likely + 1) / (n.sum() + 2), 0.05, 0.95))
        if np.abs(likely - before).max() < 1e-9:
            break
    return dict(zip(patterns, likely.tolist(), strict=True))


def train(counts: dict[tuple[int, ...], int], likely: dict[tuple[int, ...], float], steps: int = 60) -> list[float]:
    """A logistic classifier of the features, taught by the likelihoods; Newton's method."""
    patterns = sorted(counts)
    x = np.array([_features(p) for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    y = np.array([likely[p] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the patterns of votes over all whole texts, estimate and train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for t in batch["text"]:
                text = t.as_py() or ""
                for kind, start, end, base in candidates(text):
                    seen[kind, ",".join(map(str, votes(text, kind, start, end, base)))] += 1
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([seen[k] for k in keys], pa.int64())], ["kind", "pattern", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, pattern string, n long")
    model = Model()
    counts: dict[str, dict[tuple[int, ...], int]] = {}
    # at most four kinds of 3**6 votes and six lengths
    for r in rows.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.kind, {})[tuple(map(int, r.pattern.split(",")))] = r.n
    for kind, of in counts.items():
        model.likely[kind] = estimate(of)
        model.weights[kind] = train(of, model.likely[kind])
    return model


def find(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans, all spans in order of kind and start)."""
    base: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    spans = []
    for kind, start, end, is_base in candidates(text):
        if is_base:
            base[kind].append((start, end))
        elif model.score(kind, votes(text, kind, start, end, False)) < ADD:
            continue
        spans.append((kind, start, end))
    return base, spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                base, spans = find(t.as_py() or "", model)
                listed = _joined([(k, s, e) for k in KINDS for s, e in base[k]])
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest(), _joined(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], names)

    schema = f"`{id_col}` long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def masked(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as one."""
    out, at = [], 0
    for kind, start, end in sorted(find(text, model)[1], key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, model: Model, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with masked texts, and their lengths if there is a column for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := v.as_py()) is None else masked(t, model) for v in batch[text_col]]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        length = F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(length_col))
        out = out.withColumn(length_col, length.cast(docs.schema[length_col].dataType))
    return out
