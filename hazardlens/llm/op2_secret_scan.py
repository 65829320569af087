"""Secret scan by assignment-aware lexing.

Pattern spans come first: assignments to a few sensitive names, access key
ids and long hex runs (``base_spans``). The lexer then reads source and
configuration syntax around every assignment operator into name-literal
pairs (``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``,
``name => x``, ``name="x"`` attributes, ``name: type = x``, ``<name>x</name>``
elements, YAML block values), with any run of blanks and tabs around
operators; a literal may stand on the next line, in parentheses or between
triple quotes. Literals written with ``+``, or side by side in parentheses,
are joined; constants are carried to the names they are assigned to, wherever
the file defines them. Each literal is scored by how sensitive its target
names are and how much it looks like a value drawn at random (or, for names
of pass phrases, like a row of unconnected words). A literal that scores
``THRESHOLD`` or more is a span, at the place where it is written, unless a
pattern span covers it. Code that refers to a value (a call, an index, a path
or name of several plain words) is no literal.

Null text counts as empty: no spans. Texts are scanned whole; names and
literals of any length are judged alike. Offsets are code points, ends
exclusive. Equal texts have equal spans. An empty table gives an empty
result; other columns are passed on by ``redacted`` and dropped by the scan.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_batches, table

# The base patterns and the kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones never match
KINDS = ("assign", "access", "hex", "literal")

THRESHOLD = 0.5
CROSSED = 10  # a run of x makes a placeholder where it is at least a tenth of the literal

# How sensitive a word of a target name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8,
    "bearer": 0.8, "mnemonic": 0.9, "signature": 0.5, "privatekey": 1.0, "accesskey": 0.9, "jwt": 0.8, "cookie": 0.5, "salt": 0.5,
}
SENSITIVE_PAIRS = {
    ("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0,
    ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("account", "key"): 0.9, ("auth", "key"): 0.9,
    ("connection", "string"): 0.8, ("pass", "phrase"): 1.0, ("seed", "phrase"): 1.0,
}
# A name ending in one of these speaks about a secret instead of holding it.
ABOUT = frozenset("id name url uri path file length len count type field label hint prompt pattern regex "
                  "policy expiry expires ttl timeout format header param parameter size limit".split())
EMPTY_VALUES = frozenset("none null nil true false undefined changeme password secret token example test "
                         "todo default string required optional unknown".split())

_OPERATOR = re.compile(r"==+|!=|<=|>=|:=|=>|=|:(?!:|//)|(?<=:):")
# Read backwards from an operator: closing quotes, then the name's parts.
_EMAN = re.compile(r"""[\x20\t]*+\n?[\x20\t]*+["'\]]{0,2}((?:\w*[A-Za-z_][.-])*[\w$]*[A-Za-z_$])""", re.ASCII)
_STRING = re.compile(r'''[fFrRbBuU]{0,2}(?:"""((?:[^"\\]++|\\[\s\S]|"(?!""))*+)"""|\'{3}((?:[^'\\]++|\\[\s\S]|'(?!\'{2}))*+)\'{3}'''
                     r'''|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`)''')
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>#]++")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_]\w*)*", re.ASCII)
_PLUS = re.compile(r"[\x20\t]*+\+[\x20\t]*+")
_BESIDE = re.compile(r"\s*+(?:\+\s*+)?")
_GAP = re.compile(r"[\x20\t]*+")
_OPEN = re.compile(r"(?:\\?\r?\n[\x20\t]*+)?(?:\(\s*+)?")
_BLOCK = re.compile(r"[|>][+-]?[1-9]?[+-]?[\x20\t]*+(?:#[^\n]*+)?\r?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*+)</\1\s*+>", re.ASCII)
# Read backwards: a path of names, such as a.b::c.
_HTAP = re.compile(r"(?:[\w$]*[A-Za-z_$](?:\.|::|\.\?))*[\w$]*[A-Za-z_$]", re.ASCII)
_TYPE = re.compile(r"""[\x20\t]*+(?:[&*?]|'\w++[\x20\t]++|(?:mut|const|dyn)[\x20\t]++)*+["']?[\w.:$]++["']?[?!]?[\x20\t]*+""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[tuple[Span, int]]:
    """Pattern spans in order, each with the offset where its secret part begins."""
    found: list[tuple[Span, int]] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(Span(m.start(), 0, m.end()), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(Span(m.start(), 1, m.end()), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _may_hold_hex(text):
        found += [(Span(m.start(), 2, m.end()), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


_HEX_MARKS = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_HEX_RUN = b"x" * 32


def _may_hold_hex(text: str) -> bool:
    return _HEX_RUN in text.encode().translate(_HEX_MARKS)


def name_score(name: str) -> float:
    """Sensitivity of a target name, by its words."""
    words = [w.lower() for w in _PARTS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    single = max(SENSITIVE.get(w, 0.0) for w in words)
    pair = max((SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:])), default=0.0)
    return max(single, pair) * (0.3 if "public" in words else 1.0)


def value_score(value: str) -> float:
    """How much a literal looks drawn at random: 0 for placeholders and prose."""
    v = value.strip()
    if len(v) < 6 or v.lower() in EMPTY_VALUES or re.search(r"\s", v) or _POSSESSIVE.match(v) or _MARK.search(v):
        return 0.0
    if CROSSED * max((m.end() - m.start() for m in _CROSSES.finditer(v)), default=0) >= len(v):
        return 0.0
    return _drawn(Counter(v))


_POSSESSIVE = re.compile(r"(your|my|the)[_-]")
_MARK = re.compile(r"\$\{|\{\{|<[^<>]+>|%\(|\*{3}|\.{3}")
_CROSSES = re.compile(r"[xX]{4,}")
_PHRASE_NAMES = frozenset("passphrase phrase mnemonic".split())
_PROSE = frozenset("the a an of and to in is it for on are as with be at by this from or not your you my enter must should "
                   "please use choose forgot invalid wrong same here".split())


def phrase_score(name: str, value: str) -> float:
    """How much the literal of a pass phrase's name looks like one: four or more unconnected words."""
    words = value.split(" ")
    plain = len(words) > 3 and all(re.fullmatch("[a-z]{3,}|[0-9]+", w) for w in words) and not _PROSE & set(words)
    return 0.8 if plain and not _PHRASE_NAMES.isdisjoint(w.lower() for w in _PARTS.findall(name)) else 0.0


def _drawn(counts: Counter) -> float:
    """How random characters with these counts look."""
    n = sum(counts.values())
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    used = "".join(counts)
    kinds = sum(bool(re.search(p, used)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w]"))
    return min(1.0, bits / 4.0) * (0.55 if kinds == 1 else 0.85 if kinds == 2 else 1.0) * min(1.0, n / 10)


class _Run:
    """Scores of the unquoted values that end where one run of characters
    ends. Such values nest (``a=b=c``): the run is counted once, and values
    are asked for from left to right."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.upto, self.end, self.counts = text, start, end, Counter(text[start:end])
        marks = [m.start() for m in _MARK.finditer(text, start, end)]
        self.last_mark = marks[-1] if marks else -1
        self.crosses = [(m.start(), m.end() - m.start()) for m in _CROSSES.finditer(text, start, end)]
        self.crosses = [(at, max(n, after)) for (at, n), after in zip(self.crosses, [
            *accumulate((n for _, n in reversed(self.crosses[1:])), max)][::-1] + [0])]

    def score(self, start: int) -> float:
        n = self.end - start
        self.counts.subtract(self.text[self.upto:start])
        self.counts, self.upto = +self.counts, start
        if n < 6 or n < 20 and self.text[start:self.end].lower() in EMPTY_VALUES or _POSSESSIVE.match(self.text, start):
            return 0.0
        at = bisect_left(self.crosses, (start, 0))
        if self.last_mark >= start or at < len(self.crosses) and CROSSED * self.crosses[at][1] >= n:
            return 0.0
        return _drawn(self.counts)


class _Value(NamedTuple):
    spans: tuple[tuple[int, int], ...]
    bare: bool = False


class _Annotation:
    """The name before a ``:`` that may begin a type, and what follows it:
    the type with its brackets' content as one ``_``."""

    def __init__(self, name: str, at: int):
        self.name, self.at, self.depth, self.top = name, at, 0, []

    def read(self, text: str, end: int) -> bool | None:
        """Reads on to ``end``; True: a whole type, None: inside its brackets, False: no type."""
        for c in text[self.at:end]:
            if c in "[<({":
                self.depth += 1
            elif c in "]>)}":
                self.depth -= 1
                if self.depth < 0:
                    return False
                self.top.append("_")
            elif not self.depth:
                if c in "\n,;=":
                    return False
                self.top.append(c)
        self.at = end
        return None if self.depth else all(map(_TYPE.fullmatch, "".join(self.top).split("|")))


class _Source:
    """A text with what is read of it from either side."""

    def __init__(self, text: str):
        self.text, self.txet = text, text[::-1]
        self.known: dict[str, _Value] = {}
        self.start = self.end = self.stop = 0  # the last bare run; ``stop``: its end without punctuation
        self.path = self.plain = self.last = 0  # where its last path, the path's plain parts, its last word begin

    def name_before(self, at: int) -> str | None:
        """The name that ends before an operator, blanks and tabs apart."""
        m = _EMAN.match(self.txet, len(self.text) - at)
        return m.group(1)[::-1] if m else None

    def bare(self, at: int) -> bool:
        """Whether an unquoted value begins here; each run is read once."""
        if self.start <= at < self.end:
            return True
        m = _BARE.match(self.text, at)
        if not m:
            return False
        self.start, self.end = m.span()
        self.stop = self.start + len(m.group().rstrip(".,;"))
        n = len(self.text)
        m = _HTAP.match(self.txet, n - self.stop, n - self.start)
        self.path = self.plain = self.last = n - m.end() if m else self.stop
        for part in re.finditer(r"[\w$]+", self.text[self.path:self.stop]):
            words = _PARTS.findall(part.group())
            if len("".join(words)) < 3 * len(words) or sum(w.isdigit() for w in words) > 1:
                self.plain = self.path + part.end()
            for w in _PARTS.finditer(part.group()):
                self.last = self.path + part.start() + w.start()
        return True

    def refers(self, at: int) -> bool:
        """Whether the unquoted value at ``at`` is code that refers to a value."""
        if not self.path <= at < self.stop:
            return False
        called = self.stop == self.end and self.text[self.end:self.end + 1] in ("(", "[")
        return called or self.plain <= at < self.last

    def block(self, operator: int, at: int) -> _Value | None:
        """The lines of a YAML block value, deeper than the line of its name."""
        line = self.text.rfind("\n", 0, operator) + 1
        outer = _GAP.match(self.text, line).end() - line
        inner, spans = 0, []
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            begin = _GAP.match(self.text, at, stop).end()
            if begin < stop:
                if begin - at < max(inner, outer + 1):
                    break
                inner = inner or begin - at
                spans.append((begin, begin + len(self.text[begin:stop].rstrip())))
            at = stop + 1
        return _Value(tuple(spans)) if spans else None

    def value(self, operator: int, at: int) -> _Value | None:
        """The value behind an operator: literals and known constants that are joined."""
        text, spans = self.text, []
        at = _GAP.match(text, at).end()
        if text[operator] == ":" and (m := _BLOCK.match(text, at)):
            return self.block(operator, m.end())
        begin = _OPEN.match(text, at)
        joint = _BESIDE if begin.group().rstrip().endswith("(") else _PLUS
        if begin.end() > at:
            if not _STRING.match(text, begin.end()):
                return None
            at = begin.end()
        while True:
            if m := _STRING.match(text, at):
                spans.append(m.span(m.lastindex))
            elif (m := _IDENTIFIER.match(text, at)) and m.group() in self.known:
                spans.extend(self.known[m.group()].spans)
            elif not spans and self.bare(at):
                return _Value(((at, max(at, self.stop)),), True)
            else:
                break
            more = joint.match(text, m.end())
            if not more:
                break
            at = more.end()
        return _Value(tuple(spans)) if spans else None


def pairs(text: str) -> list[tuple[str, _Value]]:
    """Name-literal pairs in order; constants stand for their literals. Pairs
    by constants that are defined further on, and elements, follow at the end."""
    source = _Source(text)
    out: list[tuple[str, _Value]] = []
    later: dict[str, str] = {}  # names that stand for names not yet known
    typed: _Annotation | None = None
    for m in _OPERATOR.finditer(text):
        names = []
        if typed and m.group() in ("=", ":", "=>"):
            whole = typed.read(text, m.start())
            if whole and m.group() == "=":
                names.append(typed.name)
            if whole is not None and not (m.group() == ":" and text[m.start() - 1] == ":"):  # "::" is part of a type
                typed = None
        if m.group() not in ("=", ":", ":=", "=>"):
            continue
        name = source.name_before(m.start())
        if name:
            names.append(name)
            if m.group() == ":" and not typed:
                typed = _Annotation(name, m.end())
        if not names:
            continue
        value = source.value(m.start(), m.end())
        if not value:
            continue
        if value.bare:
            start, end = value.spans[0]
            i = _IDENTIFIER.match(text, start)
            if i and i.end() == end:
                later.update((n, i.group()) for n in names)
            if source.refers(start):
                continue
        for name in names:
            source.known[name] = value
            out.append((name, value))
    for name in later:
        seen, at = {name}, later[name]
        while at in later and at not in seen:
            seen.add(at)
            at = later[at]
        if at in source.known and at not in seen:
            out.append((name, _Value(source.known[at].spans)))
        later.update(dict.fromkeys(seen, at))  # each chain is walked once
    if "</" in text:
        out += [(m.group(1), _Value(((m.start(2), m.start(2) + len(m.group(2).rstrip())),))) for m in _ELEMENT.finditer(text)]
    return out


def literal_spans(text: str) -> set[tuple[int, int]]:
    """Places of literals that reach a sensitive name."""
    found: set[tuple[int, int]] = set()
    if "=" not in text and ":" not in text and "</" not in text:
        return found
    scores: dict[tuple[tuple[int, int], ...], float] = {}
    run: _Run | None = None
    for name, value in pairs(text):
        s = name_score(name)
        if s < THRESHOLD:
            continue
        if value.spans not in scores:
            start, end = value.spans[0]
            if value.bare:
                if not run or run.end != end or run.upto > start:
                    run = _Run(text, start, end)
                scores[value.spans] = run.score(start)
            else:
                scores[value.spans] = value_score("".join(text[a:b] for a, b in value.spans))
        looks = scores[value.spans]
        if not looks and len(value.spans) == 1 and not value.bare:
            looks = phrase_score(name, text[slice(*value.spans[0])])
        if s * looks >= THRESHOLD:
            found.update(x for x in value.spans if x[1] > x[0])
    return found


def scan(text: str | None) -> tuple[list[tuple[Span, int]], list[Span]]:
    """Pattern spans (with the start of the secret part) and added literal spans."""
    text = text or ""
    base = base_spans(text)
    extra = [Span(s, 3, e) for s, e in sorted(literal_spans(text))
             if not any(b.start <= s and e <= b.end for b, _ in base)]
    return base, extra


def _digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(map(str, spans)).encode()).hexdigest()


SCAN_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("n_literal", T.LongType()),
])


def scanned(docs: DataFrame) -> DataFrame:
    def make():
        def run(cols):
            out = {f.name: [] for f in SCAN_SCHEMA}
            for i, text in zip(cols["doc_id"], cols["text"]):
                base, extra = scan(text)
                spans = [b for b, _ in base]
                n = Counter(b.kind for b in spans)
                for k, v in zip(out, (i, n[0], n[1], n[2], _digest(spans), ",".join(map(str, sorted(spans + extra))), len(extra))):
                    out[k].append(v)
            return out
        return run

    return map_batches(docs.select("doc_id", "text"), make, SCAN_SCHEMA)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret replaced; the names before them stay."""
    if not text:
        return text
    base, extra = scan(text)
    spans = sorted([(at, s.end) for s, at in base] + [(s.start, s.end) for s in extra])
    out, upto = [], 0
    for start, end in spans:
        if start >= upto:
            out += [text[upto:start], mark]
        upto = max(upto, end)
    return "".join(out) + text[upto:] if spans else text


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; secrets in text are masked, n_chars follows."""
    schema = docs.schema

    def make():
        def run(cols):
            cols["text"] = [redact(t) for t in cols["text"]]
            if "n_chars" in cols:
                cols["n_chars"] = [n if t is None else len(t) for n, t in zip(cols["n_chars"], cols["text"])]
            return cols
        return run

    return map_batches(docs, make, schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
