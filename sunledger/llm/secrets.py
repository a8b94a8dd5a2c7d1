"""Secret scans by assignment-aware lexing.

Text is read as source or configuration syntax into name-literal pairs: ``name = literal``,
``name: literal``, ``name := a + b``, typed (``name: string = ...``) and chained (``x = name = ...``)
targets, comparisons with a literal, continued lines, triple quotes, block scalars, elements
``<name>literal</name>``, arguments of a call. Once the whole text is read, names stand for what they
were last bound to before, or else first bound to later. The constant that a target receives is
scored as a whole and each of its literals alone; all literals of a sensitive one are reported.
Three fixed patterns (``assign``, ``access``, ``hex``) are reported as well, whatever the target.

* A null text counts as empty; an empty text has no spans. Every row gives one row, repeated
  rows included; a null id is kept as null. Columns other than id and text are not read.
* Offsets are code points, ends exclusive. One piece is reported once, with its best score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import decoded, raw, record_batch, table

KINDS = ("assign", "access", "hex", "literal")
# fixed values: the base patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

# fixed values: target names and how much each says
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0,
             "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
             "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9,
             "signingkey": 0.9, "encryptionkey": 0.9, "bearer": 0.8, "authorization": 0.8,
             "auth": 0.6, "key": 0.5, "salt": 0.5, "pin": 0.4}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "xxxx", "****", "none",
                "null", "true", "false", "todo", "redacted", "undefined")

_WS = r"(?:[ \t]|\\\r?\n)*+"
_TARGET = re.compile(
    r"""(?<![\w$.-])([A-Za-z_$][\w$.-]*+)["'\]]{0,2}"""
    r"(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.]*+(?:[<\[][\w., |]*+[>\]])?(?=[ \t]*+=[^=]))?"  # a type
    rf"""({_WS})(:=|=>|[=!]==?(?=[ \t]*+["'])|[:=](?!=)){_WS}""", re.ASCII)
_TERM = re.compile(
    r'(?:[rRbBuUfF]{1,2}(?=["\']))?(?:"""(.*?)"""|\'\'\'(.*?)\'\'\''
    r'|"((?:[^"\\\n]|\\.)*+)"' r"|'((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`)"
    r"|\$\{?([A-Za-z_]\w*+)\}?|([A-Za-z0-9+/_.=-]++)", re.ASCII | re.DOTALL)
_JOIN = re.compile(rf"""{_WS}(?:\+(?:{_WS}\r?\n)?|\.){_WS}(?=["'`$A-Za-z_])""", re.ASCII)
_USE = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?", re.ASCII)
_BLOCK = re.compile(r"[|>][+-]?[ \t]*+\r?\n")
_LINE = re.compile(r"([ \t]*+)([^\r\n]*+)(?:\r?\n|\Z)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1>", re.ASCII)
_NEXT = re.compile(r"\s*+,\s*+(?:[A-Za-z_]\w*+[ \t]*+=[ \t]*+)?", re.ASCII)
_CLOSE = re.compile(r"\s*+\)(?:\.\w++\([^()\n]*+\))*+", re.ASCII)
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")


def name_weight(name: str) -> float:
    """The most telling word, or pair of neighbouring words, of a target name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in (*parts, *pairs)), default=0.0)


class Constant:
    """What a score needs of a constant. It adds up over concatenation, so that no text is copied
    along a chain of assignments."""

    def __init__(self, value: str = ""):
        low = value.lower()
        self.size, self.characters = len(value), Counter(value)
        self.excluded = " " in value or any(p in low for p in PLACEHOLDERS)

    def add(self, other: Constant) -> None:
        self.size += other.size
        self.characters.update(other.characters)
        self.excluded |= other.excluded

    def weight(self) -> float:
        """0 to 1: long, mixed and of high entropy is likelier a secret than a word."""
        if self.size < 8 or self.excluded:
            return 0.0
        shares = [c / self.size for c in self.characters.values()]
        kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else
                     "0" if "0" <= c <= "9" else "-" for c in self.characters})
        return min(1.0, -sum(x * math.log2(x) for x in shares) / 4.0) * (
            0.4 if kinds == 1 else 0.8 if kinds == 2 else 1.0)


def literal_weight(value: str) -> float:
    return Constant(value).weight()


Piece = tuple[str | None, tuple[int, int] | None]  # a name, a literal, or a word that is either


class Lexer:
    """Reads one text into values (lists of pieces) and the names they are bound to."""

    def __init__(self, text: str):
        self.text = text
        self.values: list[list[Piece]] = []
        self.targets: list[tuple[str, int]] = []
        at = 0
        while target := _TARGET.search(text, at):
            names = [target[1]]
            at = target.end()
            while (inner := _TARGET.match(text, at)) and self.is_chained(inner):
                names.append(inner[1])
                at = inner.end()
            at = self.block(names, target.start(), at) or self.expression(names, at)
        for element in _ELEMENT.finditer(text):
            self.lines([element[1]], *element.span(2))

    def is_chained(self, inner: re.Match) -> bool:
        """``a=b`` without blanks or quotes is a word, not a further target."""
        text, end = self.text, inner.end()
        apart = inner[2] or text[end - 1] in " \t\n" or text[end:end + 1] in ("'", '"')
        return bool(apart and (_TERM.match(text, end) or _TARGET.match(text, end)))

    def bind(self, names: list[str], pieces: list[Piece]) -> None:
        if pieces:
            self.values.append(pieces)
            self.targets += [(name, len(self.values) - 1) for name in names]

    def lines(self, names: list[str], start: int, end: int) -> None:
        """Every line of a longer literal is a constant of its own."""
        while start < end:
            stop = self.text.find("\n", start, end)
            stop = end if stop < 0 else stop
            part = self.text[start:stop]
            a = start + len(part) - len(part.lstrip())
            if part.strip():
                self.bind(names, [(None, (a, a + len(part.strip())))])
            start = stop + 1

    def block(self, names: list[str], target: int, at: int) -> int | None:
        """A block scalar: lines that are blank or deeper than the line of their name."""
        if not (head := _BLOCK.match(self.text, at)):
            return None
        start = self.text.rfind("\n", 0, target) + 1
        depth, at = len(_LINE.match(self.text, start)[1]), head.end()
        while at < len(self.text):
            line = _LINE.match(self.text, at)
            if line[2] and len(line[1]) <= depth:
                break
            self.lines(names, *line.span(2))
            at = line.end()
        return at

    def expression(self, names: list[str], at: int) -> int:
        """Terms joined by + or a dot; the arguments of a call are values of their own."""
        pieces: list[Piece] = []
        while term := _TERM.match(self.text, at):
            at = term.end()
            if term[7] and self.text[at:at + 1] == "(":
                at = self.arguments(names, at + 1)
            elif term[1] is not None or term[2] is not None:
                self.lines(names, *term.span(1 if term[1] is not None else 2))
            elif term[6]:
                pieces.append((term[6], None))
            elif term[7]:
                pieces.append((term[7], term.span(7)))
            else:
                kind = next(i for i in (3, 4, 5) if term[i] is not None)
                pieces.append((None, term.span(kind)))
                pieces += [(use[1], None) for use in _USE.finditer(term[kind])]
            if not (more := _JOIN.match(self.text, at)):
                break
            at = more.end()
        self.bind(names, pieces)
        return at

    def arguments(self, names: list[str], at: int) -> int:
        while term := _TERM.match(self.text, at):
            at = term.end()
            for kind in (3, 4, 5):
                if term[kind] is not None:
                    self.bind(names, [(None, term.span(kind))])
            if not (more := _NEXT.match(self.text, at)):
                break
            at = more.end()
        close = _CLOSE.match(self.text, at)
        return close.end() if close else at


class Bindings:
    """Values as a graph: each has its own literals and the values it was built from."""

    def __init__(self, lexer: Lexer):
        first: dict[str, int] = {}
        for name, value in lexer.targets:
            first.setdefault(name, value)
        self.text, self.literals, self.parts = lexer.text, [], []
        last: dict[str, int] = {}
        targets, t = lexer.targets, 0
        for at, pieces in enumerate(lexer.values):
            literals, parts = [], []
            for name, span in pieces:
                value = last.get(name, first.get(name)) if name else None
                if value is not None:  # a name bound to itself alone holds nothing
                    parts += [value] if value != at else []
                elif span:
                    literals.append(span)
            self.literals.append(literals)
            self.parts.append(parts)
            while t < len(targets) and targets[t][1] == at:
                last[targets[t][0]] = at
                t += 1

    def constant(self, value: int, known: dict[int, Constant]) -> Constant:
        """A value with all it was built from; a value inside itself adds nothing."""
        todo, open_ = [value], set()
        while todo:
            at = todo[-1]
            waiting = [p for p in self.parts[at] if p not in known and p not in open_]
            if at not in known and at not in open_ and waiting:
                open_.add(at)
                todo += waiting
                continue
            todo.pop()
            if at not in known:
                known[at] = whole = Constant()
                for a, b in self.literals[at]:
                    whole.add(Constant(self.text[a:b]))
                for part in self.parts[at]:
                    if part in known and part != at:
                        whole.add(known[part])
        return known[value]

    def spread(self, marks: list[tuple[float, int]], found, score) -> None:
        """Visit what lies behind the marked values, greatest mark first, so each of them once."""
        seen: set[int] = set()
        for mark, value in sorted(marks, reverse=True):
            todo = [value]
            while todo:
                if (at := todo.pop()) not in seen:
                    seen.add(at)
                    todo += self.parts[at]
                    for span in self.literals[at]:
                        if span[1] > span[0]:
                            found[span] = max(found.get(span, 0.0), score(mark, span))


def sensitive_literals(text: str, threshold: float = 0.5) -> dict[tuple[int, int], float]:
    """Spans of literals that reach a sensitive name, with their scores."""
    lexer = Lexer(text)
    marks = [(w, value) for name, value in lexer.targets if (w := name_weight(name))]
    if not marks:
        return {}
    bound, known = Bindings(lexer), {}
    found: dict[tuple[int, int], float] = {}
    bound.spread(marks, found, lambda w, span: w * literal_weight(text[span[0]:span[1]]))
    # a constant of one literal was scored as that
    folded = [(w * bound.constant(value, known).weight(), value) for w, value in marks
              if bound.parts[value] or len(bound.literals[value]) > 1]
    bound.spread([m for m in folded if m[0] >= threshold], found, lambda w, span: w)
    return {span: score for span, score in found.items() if score >= threshold}


def spans_of(text: str) -> list[tuple[int, int, str, float]]:
    """All spans as (start, order of the kind, end, score)."""
    low = text.lower()
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), 1.0) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end(), 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        out += [(a, 3, b, s) for (a, b), s in sensitive_literals(text).items()]
    return sorted(out)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: (kind, start, end, score) by start, then kind."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            schema = pa.schema([("doc_id", ids.type), ("spans", spans)])
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": s}
                     for a, k, b, s in spans_of(decoded(t))]
                    for t in batch.column("text").to_pylist()]
            yield record_batch({"doc_id": ids, "spans": rows}, schema)

    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(
        scan, f"doc_id {id_type}, spans array<struct<kind string, start bigint, end bigint, "
              "score double>>")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op6_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))
