"""Secret scans: fixed patterns, and literals that source or configuration text gives to sensitive names.

The scan lexes assignments into a target name and the literals on the right, follows names that
stand for a literal (constants) to where it was written, and scores each literal by its target's name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wtel.llm.common import slices

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "literal")
MASK = "[SECRET]"
#: Product of name and literal scores from which a literal is a secret.
THRESHOLD = 0.45
#: Words of a name and how much they tell; two words joined by + must both be there.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "pin": 0.5, "secret": 1.0, "token": 1.0,
    "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "bearer": 0.9, "auth": 0.7, "authorization": 0.8,
    "signing": 0.7, "encryption": 0.6, "salt": 0.6, "jwt": 0.9, "api+key": 1.0, "private+key": 1.0, "access+key": 1.0,
    "client+key": 0.8, "account+key": 0.9, "storage+key": 0.9, "ssh+key": 0.9, "connection+string": 0.9, "webhook": 0.5,
}
#: Words of a name that speak against a secret, with what is taken off.
HARMLESS = {
    "name": 0.5, "id": 0.2, "file": 0.6, "path": 0.6, "dir": 0.6, "url": 0.4, "uri": 0.4, "hint": 0.8, "label": 0.8, "field": 0.8,
    "length": 0.9, "min": 0.6, "max": 0.6, "count": 0.9, "type": 0.7, "public": 0.6, "example": 0.7, "regex": 0.8,
    "pattern": 0.8, "policy": 0.8, "prompt": 0.8, "message": 0.7, "expiry": 0.8, "expires": 0.8, "ttl": 0.8,
}
#: Literals that stand for a value to be filled in.
PLACEHOLDER = re.compile(
    r"(?:x+|\*+|\.+|none|null|nil|true|false|undefined|todo|test|changeme|change_me|placeholder|redacted|hidden)$"
    # words alone, one of them example or your
    r"|(?=[a-z]*(?:[ _.@:/-][a-z]*)*[ _.-]?[0-9]{0,4}\Z)(?:.*[^a-z])?(?:examples?|your)(?![a-z])"
    r"|.*(?:<[^<>]*>|\$\{|\{\{|%\()",
    re.I | re.A | re.S,
)
#: Longest name that is read.
NAME_LENGTH = 256
STRUCT = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SIGN = re.compile(r"=>|:=|(?<![=!<>:])[:=](?![=:])")
_NAME = re.compile(r"""([A-Za-z_$][A-Za-z0-9_$.\-]*+)["']?\]?[ \t]*+\Z""")
#: A type after a name, as in ``name: type =`` or ``var name type =``.
_TYPE = r"""[&*]*+(?:'[a-z]++\x20)?(?:(?:mut|const|dyn)\x20)?[A-Za-z_]\w*+(?:(?:\.|::)\w++)*+(?:[<\[][^\n=;{}]*[>\]])?(?:\[\])*[?!*]*"""
_TYPED = re.compile(
    rf"""(?:\b(?:var|const)[ \t]++([A-Za-z_]\w*+)[ \t]++|([A-Za-z_$][A-Za-z0-9_$.\-]*+)["'\]]*+[?!]?[ \t]*+:(?!:)[ \t]*+)"""
    rf"""{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE})*[ \t]*\Z""",
    re.A,
)
#: Letters before a quote that say how the literal is read.
_PREFIX = r"(?:[bBrRuUfFL]{1,2}|u8|[@$]{1,2})?+"
_QUOTED = re.compile(
    _PREFIX
    + r'''(?:"""([^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+)"""|\'{3}([^'\\]*+(?:(?:\\.|'(?!\'\'))[^'\\]*+)*+)\'{3}'''
    r'''|"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`([^`\n]*+)`)''',
    re.S,
)
_FILLED = re.compile(r"(?<!\{)\{[^{}\n]*\}")
_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*+")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>]++""")
_LINE_END = re.compile(r"[ \t]*+(?:[;,]?[ \t]*+(?:#[^\n]*+|//[^\n]*+)?)(?:\r?\n|\Z)")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+|[ \t]++(?=" + _PREFIX + r"[\"'])")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_BLANK = re.compile(r"[ \t]*+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns; per kind leftmost and not overlapping, short ones dropped."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_score(name: str) -> float:
    """How much a target's name speaks for a secret, 0 to 1."""
    words = [w.lower() for w in _PARTS.findall(name)]
    have = set(words) | {w[:-1] for w in words if w.endswith("s")}
    best = max((v for k, v in SENSITIVE.items() if have.issuperset(k.split("+"))), default=0.0)
    return max(0.0, best - max((HARMLESS[w] for w in words if w in HARMLESS), default=0.0))


#: Characters up to which a joined value is kept as text; a longer one is scored by its counts.
KEPT_LENGTH = 512
#: Parts of a longer value that stand for something to be filled in.
_OPEN = re.compile(r"<[^<>]*>|\$\{|\{\{|%\(")
#: Occurrences of a character in a joined value that are told apart.
MOST_COUNTED = 1 << 20


class Value:
    """What a name stands for: a literal, or values joined by +.

    A joined value refers to its parts and is never spelt out beyond ``KEPT_LENGTH``, so that a constant added to
    itself on each line costs a line's work, not twice that of the line before.
    """

    __slots__ = ("span", "parts", "text", "counts", "is_open")

    def __init__(self, text: str | None, span: tuple[int, int] | None = None, parts: tuple = (), counts=None, is_open: bool = False):
        self.text, self.span, self.parts, self.counts, self.is_open = text, span, parts, counts, is_open

    def characters(self) -> Counter:
        """Occurrences of each character (of its lowest byte, in long values)."""
        if self.counts is None:
            whole = self.text or ""
            self.counts = Counter(whole) if len(whole) <= KEPT_LENGTH else Counter(chr(ord(c) & 255) for c in whole)
            self.is_open = self.is_open or bool(_OPEN.search(whole))
        return self.counts

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        texts = [p.text for p in parts]
        if all(t is not None for t in texts) and sum(map(len, texts)) <= KEPT_LENGTH:
            return cls("".join(texts), parts=tuple(parts))
        counts: Counter = Counter()
        for p in parts:
            for c, k in p.characters().items():
                c = chr(ord(c) & 255)
                counts[c] = min(counts[c] + k, MOST_COUNTED)
        return cls(None, parts=tuple(parts), counts=counts, is_open=any(p.is_open for p in parts))

    def score(self) -> float:
        """How much the value looks like a chosen or random one, 0 to 1: its total entropy and classes."""
        counts = self.characters()
        n = sum(counts.values())
        if n < 6 or (PLACEHOLDER.match(self.text) if self.text is not None else self.is_open):
            return 0.0
        bits = sum(-c * math.log2(c / n) for c in counts.values())
        classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        blank = " " in (self.text.strip() if self.text is not None else counts)
        plain = classes == 1 and n < 20 or blank
        return min(1.0, bits / 40) * (0.5 if plain else 1.0)


def literal_score(value: str) -> float:
    """``Value.score`` of a literal."""
    return Value(value).score()


def _spans_of(values: list[Value]) -> list[tuple[int, int]]:
    """Where the literals were written that the values are made of; every value is looked at once."""
    seen: set[int] = set()
    out, open_ = set(), list(values)
    while open_:
        value = open_.pop()
        if id(value) in seen:
            continue
        seen.add(id(value))
        if value.span and value.span[1] > value.span[0]:
            out.add(value.span)
        open_ += value.parts
    return sorted(out)


def _right_side(text: str, at: int, known: dict[str, Value], tight: bool) -> list[Value]:
    """The values after a sign: quoted, named, joined by +, or a bare token."""
    out: list[Value] = []
    at = _BLANK.match(text, at).end()
    while True:
        if m := _QUOTED.match(text, at):
            group = m.lastindex
            value = m[group]
            if "f" in (prefix := text[at : m.start(group)].lower()) or "$" in prefix:
                value = _FILLED.sub("", value)
            out.append(Value(value, m.span(group)))
        elif (m := _WORD.match(text, at)) and m[0] in known:
            out.append(known[m[0]])
        elif not out and (m := _BARE.match(text, at)) and (tight or _LINE_END.match(text, m.end())):
            return [Value(m[0], m.span())]
        else:
            return out
        at = m.end()
        joined = _PLUS.match(text, at)
        if not joined:
            return out
        at = joined.end()


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    known: dict[str, Value] = {}
    found: list[Value] = []
    for sign in _SIGN.finditer(text):
        left = text[max(0, sign.start() - NAME_LENGTH) : sign.start()]
        name, typed = _NAME.search(left), None
        if sign[0] == "=":
            typed = _TYPED.search(left, left.rfind("\n") + 1)
        # a word before the sign may be a type: the name before it counts too
        names = [m for m in (name and name[1], typed and (typed[1] or typed[2])) if m]
        if not names:
            continue
        tight = sign[0] == "=" and bool(name) and name.end(1) == len(left)
        parts = _right_side(text, sign.end(), known, tight)
        if not parts:
            for n in names:
                known.pop(n, None)
            continue
        value = Value.joined(parts)
        known.update(dict.fromkeys(names, value))
        weight = max(map(name_score, names))
        if weight >= threshold and weight * value.score() >= threshold:
            found.append(value)
    return [("literal", a, b) for a, b in _spans_of(found)]


def all_spans(text: str, threshold: float = THRESHOLD) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(text)
    more = literal_spans(text, threshold) if "=" in text or ":" in text else []
    return base, ordered([*base, *more]) if more else base


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """The text with each run of overlapping spans replaced."""
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans of every text: arrays of kind, start, end in code points, end exclusive.

    ``base`` holds the matches of the fixed patterns, ``spans`` these and the literals found by
    lexing, in order of start, kind and end. Names longer than 256 characters are read from their last 256.

    Null, empty and clean texts have empty arrays. Only doc_id and text are read, so other columns
    cannot clash; every row gives one row, repeated rows and null ids too. Long texts are scanned
    whole. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text"):
                found = [all_spans(t, threshold) if t else ([], []) for t in part.column("text").to_pylist()]
                rows = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in found] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(rows[0], kind), pa.array(rows[1], kind)], ["doc_id", "base", "spans"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {STRUCT}, spans {STRUCT}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def masked_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret in ``text`` replaced by ``MASK``; n_chars follows the text.

    Other rows and columns are unchanged, and so is a null or empty text. Repeated rows are masked alike, null ids
    stay, texts of any length are read whole, and columns beside text and n_chars are passed on
    whatever their names. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, lengths = part.column("text").to_pylist(), part.column("n_chars").to_pylist()
                for i, text in enumerate(texts):
                    if text and (spans := all_spans(text, threshold)[1]):
                        texts[i] = masked(text, spans)
                        lengths[i] = len(texts[i])
                columns = {n: part.column(n) for n in part.schema.names}
                columns |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array(lengths, part.schema.field("n_chars").type)}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)
