"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

Base spans, leftmost and non-overlapping for each kind:
  assign  a sensitive word, an optional quote, = or :, and a value of 6 or more characters,
  access  an AKIA key of 20 or more characters,
  hex     a run of 24 or more lower-case hexadecimal digits.
The lexer adds spans of kind "literal". It reads source and configuration text as tokens (names, plain or dotted; quoted strings with
escapes, also triple ones; comments; brackets; tags with attributes; YAML blocks) and forms pairs of a name and a value:
  name = value, name: value, name: type = value, name == value, "name": value, x["name"] = value, NAME=value, --name value,
  <name>value</name>, <tag name="value">, <tag key="name" value="value">, name: | and an indented block,
  and, within the brackets of a value, its items and arguments (name = f("literal"), "names": {"x": "literal"}).
A value is a chain of terms joined by + or by standing side by side. Strings and bare words are literals; names, plain or dotted, stand
for the literals that were bound to them before (constant propagation); calls and subscripts stand for nothing. The literals of
a chain are scored together, by the target's name (with those of the brackets around it) and by their own form, and if the score
reaches MIN_SCORE each becomes a span. Literals have any length and are read in linear time. What strings hold is lexed too,
with names of its own. A comment is lexed by itself: what it assigns is told, but bound for nothing outside. Lines without
a separator are passed over unless a sensitive bracket is open. A base span is never dropped or changed.

Offsets are code points, ends exclusive. Defined cases: null counts as the empty text (no spans); equal rows give equal
results; an empty table gives an empty result; other columns are ignored (scan) or kept (redact).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
MIN_SCORE = 1.0
MASK = "[secret]"

# The three base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run that fails on length holds no other run
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

# Parts of names and what they add to a score.
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0, "auth": 0.5,
    "authorization": 0.6, "bearer": 0.6, "key": 0.3, "conn": 0.2, "dsn": 0.5,
}
# Literals that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "redacted", "password", "secret", "token", "none", "null", "true", "false", "undefined", "xxxxxx", "your_password", "your_token", "your_api_key"}

# Possessive, so each is read once; names and literals have any length.
_WORD = r"[A-Za-z_$@][\w$]*+(?:(?:\.|->|::|-)[\w$]++)*+"
_COMMENT = r"(?P<comment>(?:(?<!\S)\#|(?<![:\w/])//|(?<!\S)--(?=[ \t]))[^\n]*+)|(?P<block>/\*|<!--)|"
_CODE = (
    r"""(?P<line>\n)"""
    r"""|(?P<string>(?<![\w\\])[bfruBFRU]{0,2}(?:\"{3}|'{3}|["'`]))"""
    r"""|<(?P<tag>[A-Za-z_][\w.:-]*+)"""
    r"""|(?<!\S)--(?P<flag>[A-Za-z][\w-]*+)(?P<after>=|[ \t]++)"""
    rf"""|(?P<name>{_WORD})"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])"""
)
_TOKEN, _COMMENTED = re.compile(_COMMENT + _CODE), re.compile(_CODE)  # a comment holds no other
_QUOTED = {'"': re.compile(r'"((?:[^"\\\n]++|\\.)*+)"'), "'": re.compile(r"'((?:[^'\\\n]++|\\.)*+)'"), "`": re.compile(r"`((?:[^`\\\n]++|\\.)*+)`")}
_PREFIX = re.compile(r"[bfruBFRU]{0,2}(?=[\"'`])")
_NAME = re.compile(_WORD)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_FLAGGED = re.compile(r"""[^\s"'`,;]++""")
_SEPARATOR = re.compile(r"[ \t]*+(?::=|=>|={1,3}|:(?!:))[ \t]*+")
_TYPED = re.compile(r"[A-Za-z_][\w.]*+(?:\[[^\]\n]*+\])?[ \t]*+=(?!=)[ \t]*+")
_KEYED = re.compile(r"\s*+(?::|=>)\s*+")
_SUBSCRIPT = re.compile(r"\][ \t]*+={1,3}[ \t]*+")
_JOINED = re.compile(r"\s*+\+\s*+|[ \t]*+\\\n[ \t]*+|[ \t]*+(?=[\"'])")
_JOINED_INSIDE = re.compile(r"\s*+\+\s*+|[ \t]*+\\\n[ \t]*+|\s*+(?=[\"'])")
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*+\n")
_INDENT = re.compile(r"[ \t]*+")
_ATTRIBUTE = re.compile(r"""\s*+/?(?P<name>[A-Za-z_][\w.:-]*+)\s*+=\s*+""")
_TAGGED = re.compile(r"\s*+>([^<>]++)</")
_MARK = re.compile(r"[=:<]|--|/\*|\"{3}|'{3}")
_PARAMETER = re.compile(r"(?<=[?&])([A-Za-z_][A-Za-z0-9_.-]*+)=([^?&]++)")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def name_score(name: str) -> float:
    """How sensitive the target of an assignment is, from the parts of its name."""
    parts = [p.lower() for p in _SPLIT.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max([0.0, *(NAME_PARTS.get(p, NAME_PARTS.get(p.removesuffix("s"), 0.0)) for p in parts + joined)])


_PRIVATE = "PRIVATE KEY-----"
_HEAD, _MOST = 16, 1 << 30  # no placeholder is longer than _HEAD; lengths count up to _MOST
_CLASSES = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))


class _Facts(NamedTuple):
    """What a literal's score needs of it. Those of joined literals follow from those of its parts."""

    length: int = 0
    head: str = ""
    tail: str = ""
    classes: int = 0  # a bit for each of _CLASSES
    blank: bool = False
    private: bool = False

    @classmethod
    def of(cls, text: str) -> _Facts:
        classes = sum(1 << k for k, c in enumerate(_CLASSES) if c.search(text))
        return cls(min(len(text), _MOST), text[:_HEAD], text[-_HEAD:], classes, " " in text, _PRIVATE in text)

    def joined(self, other: _Facts) -> _Facts:
        return _Facts(
            min(self.length + other.length, _MOST), (self.head + other.head)[:_HEAD], (self.tail + other.tail)[-_HEAD:], self.classes | other.classes,
            self.blank or other.blank, self.private or other.private or _PRIVATE in self.tail + other.head,
        )


class _Value:
    """A literal, or literals and values that are joined. Values share their parts, so a name costs no more than its own line; facts and
    counts of characters are told of each value once, and only where a sensitive name asks for them."""

    __slots__ = ("counts", "facts", "parts", "span", "text", "told")

    def __init__(self, span: tuple[int, int] | None = None, text: str = "", parts: tuple[_Value, ...] = ()):
        self.span, self.text, self.parts, self.facts, self.counts, self.told = span, text, parts, None, None, False

    def known(self) -> _Facts:
        stack = [self]
        while stack:
            v = stack[-1]
            todo = [p for p in v.parts if p.facts is None] if v.facts is None else []
            stack += todo
            if not todo:
                stack.pop()
                if v.facts is None:
                    v.facts = _Facts.of(v.text)
                    for p in v.parts:
                        v.facts = v.facts.joined(p.facts)
        return self.facts

    def entropy(self) -> float:
        """Bits for each character of the joined text."""
        if self.counts is None:
            order, seen, stack = [], set(), [(self, False)]
            while stack:  # parts before what they are parts of
                v, left = stack.pop()
                if left:
                    order.append(v)
                elif id(v) not in seen:
                    seen.add(id(v))
                    stack.append((v, True))
                    stack += [(p, False) for p in v.parts if v.counts is None]
            times, total = {id(self): 1}, Counter()
            for v in reversed(order):
                n = times[id(v)]
                if v.counts is None and v.parts:
                    for p in v.parts:
                        times[id(p)] = times.get(id(p), 0) + n
                else:
                    for c, k in (v.counts or Counter(v.text)).items():
                        total[c] += n * k
            over = max(0, sum(total.values()).bit_length() - 128)
            self.counts = {c: k >> over for c, k in total.items() if k >> over} if over else dict(total)
        n = sum(self.counts.values())
        return -sum(k / n * math.log2(k / n) for k in self.counts.values())

    def spans(self) -> list[tuple[int, int]]:
        """Places of the literals that weren't told yet, each once."""
        out, stack = [], [self]
        while stack:
            v = stack.pop()
            if not v.told:
                v.told = True
                stack += v.parts
                if v.span:
                    out.append(v.span)
        return out

    def reaches(self, least: float) -> bool:
        """Whether it looks like a secret by so much: mixed classes and entropy raise, words and references lower."""
        f = self.known()
        if f.private:
            return least <= 1.0
        if f.length < 6 or (f.length <= _HEAD and f.head.lower() in PLACEHOLDERS) or f.blank or f.head.startswith(("$", "{", "<", "%", "http://", "https://", "/")):
            return least <= -1.0
        score = 0.2 * (f.classes.bit_count() - 1) + (0.2 if f.length >= 16 else 0.0)
        return score >= least or (score + 0.3 >= least and self.entropy() >= 3)


#: What undelimited literals need above MIN_SCORE.
_BARE_MORE = 0.4


class _Frame(NamedTuple):
    """An open bracket: what closes it, the name whose value it is in, how sensitive that is, and whether any open one is sensitive."""

    close: str
    target: str
    score: float
    armed: bool

    @classmethod
    def within(cls, frames: list, bracket: str, target: str) -> _Frame:
        last = frames[-1] if frames else cls("", "", 0.0, False)
        score = max(name_score(target), last.score if bracket != "(" or target == last.target else 0.0)
        return cls(_CLOSES[bracket], target, score, last.armed or score > 0)


class _Lexer:
    """Reads a text once and gathers the spans of literals that reach sensitive names."""

    def __init__(self, text: str):
        self.text, self.out = text, set()
        self.absent: set[str] = set()  # closing marks that don't come any more
        self.block_end = 0

    def judge(self, name: str, value: _Value, least: float = MIN_SCORE, around: float = 0.0) -> None:
        """around: how sensitive the brackets around the pair are."""
        sensitive = max(around, name_score(name))
        if sensitive and not value.told and value.reaches(least - sensitive - 1e-9):
            self.out.update((a, b, KINDS[3]) for a, b in value.spans() if a < b)

    def string(self, at: int, stop: int) -> tuple[int, int, int] | None:
        """Start, end and what follows of the string whose quotes open at `at`."""
        quote = self.text[at : at + 3]
        if len(quote) == 3 and quote in ("'" * 3, '"' * 3):
            end = self.find(quote, at + 3, stop)
            return (at + 3, end, end + 3) if end >= 0 else None
        m = _QUOTED[quote[0]].match(self.text, at, stop)
        return (*m.span(1), m.end()) if m else None

    def find(self, mark: str, at: int, stop: int) -> int:
        if mark in self.absent:
            return -1
        end = self.text.find(mark, at)
        if end < 0:
            self.absent.add(mark)
        return end if 0 <= end <= stop - len(mark) else -1

    def inside(self, start: int, end: int, scopes: tuple[dict, ...], comments: bool) -> None:
        """Lexes what a string holds."""
        if end - start > 6 and _MARK.search(self.text, start, end):
            self.lex(start, end, ({}, *scopes), comments)

    @staticmethod
    def resolve(name: str, scopes: tuple[dict, ...]) -> _Value | None:
        for key in (name, name.rpartition(".")[2]):
            for scope in scopes:
                if key in scope:
                    return scope[key]
        return None

    def value(self, target: str, at: int, stop: int, scopes: tuple[dict, ...], frames: list, comments: bool, bare: re.Pattern = _BARE) -> int:
        """Reads the value of target from `at`, judges and binds it, and returns where to read on."""
        text, parts, delimited, known = self.text, [], False, True
        around = frames[-1].score if frames and frames[-1].close != ")" else 0.0
        joined = _JOINED_INSIDE if frames else _JOINED
        while True:
            quote = _PREFIX.match(text, at, stop).end() if _PREFIX.match(text, at, stop) else at
            if text[quote : quote + 1] in _QUOTED and quote < stop and (found := self.string(quote, stop)):
                start, end, at = found
                parts.append(_Value((start, end), _ESCAPED.sub(r"\1", text[start:end])))
                delimited = True
                self.inside(start, end, scopes, comments)
            else:
                m = bare.match(text, at, stop)
                word = m[0] if m else ""
                names = [w for w in word.rstrip(":").split("+") if w]
                opens = text[at + len(word) : at + len(word) + 1] in _CLOSES and at + len(word) < stop
                if names and all(_NAME.fullmatch(w) for w in names):
                    found = [None if opens else self.resolve(w, scopes) for w in names]
                    parts += filter(None, found)
                    delimited |= any(found)
                    known &= all(found)
                    if opens:  # a call or a subscript
                        frames.append(_Frame.within(frames, text[m.end()], target))
                        at = m.end() + 1
                        break
                    if not any(found) and not parts and re.search(r"\d", word):  # no name that is known: a literal
                        parts, known = [_Value((at, m.end()), word)], True
                        at = m.end()
                        break
                    at = m.end()
                    if word.endswith("+"):
                        continue
                elif word:
                    for p in _PARAMETER.finditer(text, *m.span()):
                        self.judge(p[1], _Value(p.span(2), p[2]), MIN_SCORE + _BARE_MORE)
                    if not parts:
                        parts.append(_Value(m.span(), word))
                    at = m.end()
                    break
                elif opens and not parts:
                    frames.append(_Frame.within(frames, text[at], target))
                    return at + 1
                else:
                    break
            m = joined.match(text, at, stop)
            if not m or (m.end() == m.start() and text[at : at + 1] not in _QUOTED):
                break
            at = m.end()
        if parts:
            whole = parts[0] if len(parts) == 1 else _Value(parts=tuple(parts))
            self.judge(target, whole, MIN_SCORE if delimited else MIN_SCORE + _BARE_MORE, around)
            if known:
                scopes[0][target] = whole
        return at

    def yaml(self, target: str, head: int, at: int, stop: int) -> int | None:
        """The block of indented lines after `target: |`; None where there is none."""
        text = self.text
        m = _BLOCK.match(text, at, stop)
        if not m:
            return None
        line = text.rfind("\n", 0, head) + 1
        indent = _INDENT.match(text, line).end() - line
        begin = end = at = m.end()
        lines = []
        while at < stop and at >= self.block_end:
            to = text.find("\n", at, stop)
            to = stop if to < 0 else to
            own = _INDENT.match(text, at, to).end()
            if own < to and own - at <= indent:
                break
            if own < to:
                begin = begin if lines else own
                end = to
                lines.append(text[own:to].rstrip())
            at = to + 1
        if lines:
            self.block_end = at
            self.judge(target, _Value((begin, end), "".join(lines)))
        return m.end()

    def tag(self, name: str, at: int, stop: int, scopes: tuple[dict, ...], comments: bool) -> int:
        """Attributes of an element, and its text if it has nothing else."""
        text, found = self.text, {}
        while m := _ATTRIBUTE.match(text, at, stop):
            s = self.string(m.end(), stop) if text[m.end() : m.end() + 1] in _QUOTED else None
            if not s:
                break
            found[m["name"].lower()] = _Value(s[:2], text[s[0] : s[1]])
            self.judge(m["name"], found[m["name"].lower()])
            self.inside(s[0], s[1], scopes, comments)
            at = s[2]
        said = [found[k].text for k in ("key", "name", "id") if k in found]
        for k in said if "value" in found else []:
            self.judge(k, found["value"])
        m = _TAGGED.match(text, at, stop)
        if m and text.startswith(name + ">", m.end()):
            start, end = m.span(1)
            while start < end and text[start] in " \t\n\"'":
                start += 1
            while end > start and text[end - 1] in " \t\n\"'":
                end -= 1
            scopes[0][name] = _Value((start, end), text[start:end])
            for k in [name, *said]:
                self.judge(k, scopes[0][name])
            self.inside(start, end, scopes, comments)
            at = m.end()
        return at

    def lex(self, at: int, stop: int, scopes: tuple[dict, ...], comments: bool = True) -> None:
        text, frames, token = self.text, [], _TOKEN if comments else _COMMENTED
        while True:
            m = token.search(text, at, stop)
            if not m:
                return
            kind, begin, at = m.lastgroup, m.start(), m.end()
            if kind == "line":
                if not (frames and frames[-1].armed):  # to the next line that may assign something
                    frames.clear()
                    mark = _MARK.search(text, at, stop)
                    if not mark:
                        return
                    at = max(at, text.rfind("\n", at, mark.start()) + 1)
            elif kind == "comment":
                self.lex(begin + 1, at, ({},), False)
            elif kind == "block":
                mark = "*/" if m[0] == "/*" else "-->"
                end = self.find(mark, at, stop)
                if end >= 0:
                    self.lex(at, end, ({},), False)
                    at = end + len(mark)
            elif kind == "string":
                quote = _PREFIX.match(text, begin, stop).end()
                found = self.string(quote, stop)
                if not found:
                    at = quote + 1
                    continue
                start, end, after = found
                key, sub = _KEYED.match(text, after, stop), _SUBSCRIPT.match(text, after, stop)
                if (key or sub) and _NAME.fullmatch(text, start, end):
                    if sub and frames:
                        frames.pop()
                    at = self.value(text[start:end], (key or sub).end(), stop, scopes, frames, comments)
                elif frames and frames[-1].score:
                    at = self.value(frames[-1].target, begin, stop, scopes, frames, comments)
                else:
                    self.inside(start, end, scopes, comments)
                    at = after
            elif kind == "tag":
                at = self.tag(m["tag"], at, stop, scopes, comments)
            elif kind == "after":
                at = self.value(m["flag"], at, stop, scopes, frames, comments, _FLAGGED)
            elif kind == "name":
                sep = _SEPARATOR.match(text, at, stop)
                if sep:
                    block = self.yaml(m["name"], begin, sep.end(), stop) if ":" in sep[0] else None
                    typed = _TYPED.match(text, sep.end(), stop) if ":" in sep[0] else None
                    at = block or self.value(m["name"], (typed or sep).end(), stop, scopes, frames, comments)
            elif kind == "open":
                frames.append(_Frame.within(frames, m[0], frames[-1].target if frames else ""))
            elif frames and frames[-1].close == m[0]:
                frames.pop()


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through names bound to them before, in order of start."""
    if not _MARK.search(text):
        return []
    lexer = _Lexer(text)
    lexer.lex(0, len(text), ({},))
    return sorted(lexer.out)


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those with the lexer's, by start, then kind as listed."""
    base = base_spans(text)
    return base, sorted(base + literal_spans(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def written_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each union of overlapping spans replaced by MASK."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = all_spans(t or "")
            kinds = [k for _, _, k in base]
            rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", run(F.col(text)).alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all columns, secrets in the text masked; a null text stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, all_spans(t)[1]) for t in texts], dtype=object)

    return docs.withColumn(text, run(F.col(text)))
