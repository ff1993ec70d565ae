"""Secret scan by assignment-aware lexing.

The lexer walks a text from one assignment operator to the next. To the left it reads the
target's name, to the right a quoted literal, a bare word, a sum of literals or the name of
a constant seen before in the same text. Each name-literal pair is scored by how sensitive
the name is and how random the literal looks. Pairs whose name ends in one of the contract's
key words are the ``assign`` spans; other pairs over the threshold are ``lexed`` spans, whose
place is that of the literal. Stand-alone literals, ``access`` and ``hex``, need no name.

Constants are kept as a graph: a right side holds its own literals once and points to the
constants that it names, and what the score needs (length, letters, blanks) is added up as the
sides are read. So constants made of constants cost nothing but their edges, and a bare word that
holds further assignments is counted by letters once, from its first site to its last.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

#: Fixed by the contract: key words of `assign`, value characters, and the two literal kinds.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")
MIN_VALUE = 8

#: How sensitive a part of a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "private": 0.6,
    "access": 0.4, "api": 0.4, "key": 0.5, "signature": 0.5, "bearer": 0.9,
}

_SITE = re.compile(r"[:=]")
_BACKWARDS = re.compile(r"[A-Za-z0-9_.-]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'')
_REFERENCE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")

SPANS = "array<struct<kind:string,start:long,end:long,name:string,score:double>>"
_SPAN = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]
    )
)


def name_score(name: str) -> float:
    """0 to 1: the most sensitive part of a name, or the sum of two lesser ones."""
    found = [SENSITIVE.get(p.lower(), 0.0) for p in _PART.findall(name)]
    found += [SENSITIVE["apikey"]] if "apikey" in name.lower() else []
    return min(1.0, sum(sorted(found)[-2:]))


class Letters:
    """What scoring needs to know of a string: how often each letter occurs, of 256 by its last byte, and whether blanks do."""

    __slots__ = ("n", "count", "blank", "kinds")

    def __init__(self, text: str = ""):
        self.n, self.blank, self.kinds = float(len(text)), any(c.isspace() for c in text), 0
        self.count: Counter = Counter()
        for c, n in Counter(text).items():
            self.count[ord(c) & 255] += n
            self.kinds |= c.isdigit() | c.islower() << 1 | c.isupper() << 2

    def add(self, other: Letters) -> None:
        """Both strings one after the other; lengths beyond a float's range keep their shares."""
        self.n, self.blank, self.kinds = self.n + other.n, self.blank or other.blank, self.kinds | other.kinds
        for c, n in other.count.items():
            self.count[c] += n
        if self.n > 1e200:
            self.n, self.count = self.n * 1e-100, Counter({c: n * 1e-100 for c, n in self.count.items()})

    def score(self) -> float:
        """0 to 1: short, blank-holding or monotonous literals score low."""
        if self.n < MIN_VALUE or self.blank:
            return 0.0
        entropy = -sum(c / self.n * math.log2(c / self.n) for c in self.count.values() if c > 0)
        return min(1.0, entropy / 3.5) * (0.5 if self.kinds.bit_count() < 2 else 1.0)


def literal_score(value: str) -> float:
    return Letters(value).score()


class Side:
    """A right side: places of its own literals, the constants that it names, and the letters of all."""

    __slots__ = ("places", "parts", "letters", "shown")

    def __init__(self):
        self.places: list[tuple[int, int]] = []
        self.parts: list[Side] = []
        self.letters = Letters()
        self.shown = False

    def unseen(self) -> Iterator[tuple[int, int]]:
        """Places of all literals that it is made of, but of sides that gave theirs before."""
        stack = [self]
        while stack:
            side = stack.pop()
            if not side.shown:
                side.shown = True
                yield from side.places
                stack += reversed(side.parts)


class Bare:
    """The bare word at hand and the letters from the present site to its end."""

    def __init__(self):
        self.start = self.end = self.at = 0
        self.count: Counter = Counter()

    def end_at(self, text: str, at: int) -> int:
        """Where the run of value characters ends that holds ``at``."""
        if not self.start <= at < self.end:
            m = VALUE.match(text, at)
            if not m:
                return at
            self.start, self.end, self.at = at, m.end(), -1
        return self.end

    def score(self, text: str, at: int) -> float:
        if self.at < 0:
            self.count, self.at = Counter(text[at : self.end]), at
        elif at > self.at:
            self.count.subtract(text[self.at : at])
            self.at = at
        n = self.end - at
        if n < MIN_VALUE:
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.count.values() if c > 0)
        kinds = {c.isdigit() | c.islower() << 1 | c.isupper() << 2 for c, k in self.count.items() if k > 0} - {0}
        return min(1.0, entropy / 3.5) * (0.5 if len(kinds) < 2 else 1.0)


def _keyword_before(text: str, site: int) -> int:
    """Where the key word starts that ends before the operator, or -1."""
    end = site
    while end and text[end - 1] == " ":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    for word in KEYWORDS:
        start = end - len(word)
        if start >= 0 and (part := text[start:end]).isascii() and part.lower() == word:
            return start
    return -1


def _value_after(text: str, site: int) -> re.Match | None:
    """The value as the contract's pattern takes it; called only beyond the value before."""
    at = site + 1
    while text[at : at + 1] == " ":
        at += 1
    return VALUE.match(text, at) or (VALUE.match(text, at + 1) if text[at : at + 1] in ('"', "'") else None)


def _name_before(text: str, site: int, floors: tuple[int, int]) -> str:
    """The whole name that ends before the operator; it can't reach back over the site before (``floors``: that before it, and it)."""
    end, floor = site, floors[1]
    if end and text[end - 1] == ":":  # `:=`
        end, floor = end - 1, floors[0]
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    return _BACKWARDS.match(text[floor:end][::-1])[0][::-1].lstrip("0123456789.-")


def _right_side(text: str, site: int, constants: dict[str, Side]) -> tuple[Side, int]:
    """The quoted literals and constants that the right side is made of, and where it starts."""
    at, found = site + 1, Side()
    if text[at : at + 1] == ">":
        at += 1
    while text[at : at + 1] in (" ", "\t"):
        at += 1
    start = at
    while True:
        if m := _LITERAL.match(text, at):
            value = m[1] if m[1] is not None else m[2]
            found.places.append((m.start() + 1, m.end() - 1))
            found.letters.add(Letters(value))
        elif (m := _REFERENCE.match(text, at)) and (known := constants.get(m[0])):
            found.parts.append(known)
            found.letters.add(known.letters)
        else:
            return found, start
        plus = _PLUS.match(text, m.end())
        if not plus:
            return found, start
        at = plus.end()


def lex(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, str, float]]:
    """All spans of a text, by start, then kind as listed; work is in proportion to its length."""
    spans: list[tuple[str, int, int, str, float]] = []
    constants: dict[str, Side] = {}
    bare, sites = Bare(), (0, 0)
    last, covered = 0, []  # last: where the next assign span may start; covered: places taken, in order, without overlaps

    def free(a: int, b: int) -> list[tuple[int, int]]:
        """The parts of a place that aren't taken."""
        parts = []
        for k in range(max(0, bisect.bisect_left(covered, (a,)) - 1), bisect.bisect_left(covered, (b,))):
            x, y = covered[k]
            if a < x:
                parts.append((a, x))
            a = max(a, y)
        return parts + [(a, b)] if a < b else parts

    for m in _SITE.finditer(text):
        site = m.start()
        start = _keyword_before(text, site)
        if start >= last:
            value = _value_after(text, site)
            if value:
                last = value.end()
                if len(value[0]) >= MIN_VALUE:
                    spans.append(("assign", start, last, text[start:site].rstrip(" \"'"), 1.0))
                    for part in free(start, last):
                        bisect.insort(covered, part)
        floors, sites = sites, (sites[1], site + 1)
        if text[site + 1 : site + 2] == "=" or (site and text[site - 1] in "=!<>"):
            continue
        name = _name_before(text, site, floors)
        if not name:
            continue
        side, at = _right_side(text, site, constants)
        quoted = bool(side.places or side.parts)
        if not quoted and bare.end_at(text, at) == at:
            continue
        weight = name_score(name)
        if weight >= threshold:
            score = weight * (side.letters.score() if quoted else bare.score(text, at))
            if score >= threshold:
                for a, b in side.unseen() if quoted else [(at, bare.end)]:
                    for x, y in free(a, b):
                        spans.append(("lexed", x, y, name, round(score, 6)))
                        bisect.insort(covered, (x, y))
        if quoted:
            constants[name] = side
    spans += [("access", m.start(), m.end(), "", 1.0) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), "", 1.0) for m in HEX.finditer(text)]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, keep_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``spans`` (``SPANS``) and, if asked for, ``text_col``.

    Null and empty texts have no spans; repeated rows each keep theirs; other columns are not
    looked at, whatever their names. Texts are read whole, in code points.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in lex(t, threshold)] for t in strings(batch.column(1))]
            out = [batch.column(0), pa.array(found, type=_SPAN)] + ([batch.column(1)] if keep_text else [])
            yield pa.RecordBatch.from_arrays(out, ["id", "spans", "text"][: len(out)])

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(scan, f"id {kind}, spans {SPANS}" + ", text string" * keep_text)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col) if keep_text else out.withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", threshold: float = 0.6) -> DataFrame:
    """``df`` with every span of its texts replaced by ``mask``.

    Null and empty texts stay; touching and overlapping spans are masked as one; repeated rows are masked alike, empty
    tables stay empty, and all other columns pass, whatever their names.
    """
    kinds = df.schema

    def clean(text: str | None) -> str | None:
        spans = lex(text, threshold) if text else []
        if not spans:
            return text
        out, at = [], 0
        for _, start, end, _, _ in spans:
            if start > at or not out:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            new = pa.array([clean(t) for t in batch.column(k).to_pylist()], type=batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([new if i == k else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, kinds)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan_secrets``' rows, one each; without spans counts are 0 and strings those of nothing."""
    as_text = "x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))"
    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:3]),
        F.expr(f"sha2(array_join(transform(filter(spans, x -> x.kind != 'lexed'), {as_text}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(spans, {as_text}), ',')").alias("spans"),
    )
