"""Secret scans: fixed patterns, and an assignment-aware lexer for source and configuration syntax.

The fixed patterns give the base spans. The lexer reads a text into name-literal pairs: `name = "literal"`, `name: literal`,
`"name": "literal"`, `export NAME=literal`, `name := literal`, `name => literal`, call arguments (`name("literal")`,
`f("name", "literal")`), literals joined by +, . or by standing side by side, triple-quoted literals and indented blocks
(`name: |`). It starts from the operators and reads names backwards, so that every character is looked at a fixed number of
times, however long names, blanks and literals are. Names that are assigned from other names pass their sensitivity on to
them, wherever in the text the assignments stand. Each literal is scored by how sensitive its target names are and by how random
it looks; literals that score high enough are reported as `named` spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as tk
from .common import small_batches

# The base patterns, their least lengths, and their order among spans of one start.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "named")
#: Strings of which every match of ASSIGN holds one, in lower case.
CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

# Parts of names that make an assignment sensitive, with their weights.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "privatekey": 3, "accesskey": 3, "credential": 2, "credentials": 2, "auth": 1, "bearer": 2, "signature": 1, "cookie": 1, "session": 1, "key": 1, "salt": 1, "pass": 1}

IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True

#: What an assignment or an argument is recognised by; a bracket or comma counts only before a literal.
_OPERATOR = re.compile(r"""(?P<set>:=|=>|(?<![=!<>])=(?!=)|(?<!:):(?!:|//))|\((?=\s*+["'])|,(?=\s*+["'])""")
#: Read backwards from an operator, on the reversed text: blanks, quotes or a bracket, and a name.
_BEFORE = re.compile(r"""[ \t]*+(?P<shut>["'\]]{0,2})(?P<name>[\w$]++(?:(?:\.|>-|::|-)[\w$]++)*+)(?P<open>["']?)""", re.ASCII)
_TEXT = r"""(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
_VALUE = re.compile(rf"""[ \t]*+(?:(?P<triple>"{{3}}|'{{3}})|(?P<block>[|>][+-]?[ \t]*+(?=\r?\n))|(?:\(\s*+)?(?P<text>{_TEXT}|`[^`\n]*+`)|(?P<plain>[^\s"'`,;(){{}}\[\]<>#]++))""", re.ASCII)
_ARGUMENT = re.compile(rf"\s*+(?P<text>{_TEXT})", re.ASCII)
#: After a literal: another one beside it, or an operator that joins one or a name on (a line of its own may begin with +: no name that
#: is assigned to there is joined).
_JOIN = re.compile(rf"""(?:[ \t]|\\?\r?\n)*+(?:[+.](?:[ \t]|\\?\r?\n)*+)?(?!"{{3}}|'{{3}})(?P<text>{_TEXT})(?![ \t]*+[:=])|(?:[ \t]|\\?\r?\n)*+[+.](?:[ \t]|\\?\r?\n)*+(?P<name>[A-Za-z_$][\w$]*+)(?![ \t]*+[:=])""", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][\w$.]*+\Z", re.ASCII)
_LINE = re.compile(r"\r?\n([ \t]*+)([^\r\n]*+)")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def show(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Longest runs of 0-9a-f of LEAST_HEX characters or more."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    flag = np.zeros(len(raw) + 2, np.int8)
    flag[1:-1] = (raw < 128) & IS_HEX[np.minimum(raw, 127)]
    edge = np.diff(flag)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = e - s >= LEAST_HEX
    return list(zip(s[long].tolist(), e[long].tolist(), strict=True))


def base_spans(text: str, cued: bool = True, hexed: bool = True) -> list[Span]:
    """Spans of the fixed patterns, by start and kind. cued, hexed: whether the text may have matches of ASSIGN, of hex."""
    out = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if cued else []
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if hexed:
        out += [Span(a, 2, b) for a, b in hex_runs(text)]
    return sorted(out)


def name_weight(name: str) -> int:
    """How sensitive an assignment's target is: the heaviest of its parts and of neighbouring parts taken together."""
    parts = [p.lower() for p in _PART.findall(name)]
    return max((SENSITIVE.get(x, 0) for x in [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]), default=0)


def is_path(value: str) -> bool:
    """Whether a value that begins with / looks like a path: not like base64, where lower case, upper case and digits alternate."""
    kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "" for c in value]
    pairs = [a != b for a, b in zip(kind, kind[1:], strict=False) if a and b]
    return not (len(value) >= 16 and {"d", "l", "u"} <= set(kind) and sum(pairs) >= 0.4 * len(pairs))


def literal_weight(value: str) -> int:
    """How much a literal looks like a secret: length, entropy, and kinds of characters; 0 for plain words and placeholders."""
    if len(value) < 8 or len(set(value)) < 5 or any(c.isspace() for c in value) or value.startswith(("${", "{{", "%(", "<", "http:", "https:", "./")) or (value.startswith("/") and is_path(value)):
        return 0
    n = Counter(value)
    bits = -sum(k / len(value) * math.log2(k / len(value)) for k in n.values())
    kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)
    return (bits >= 3.0) + (kinds >= 2) + (len(value) >= 16 and any(c.isdigit() for c in value))


class Literal(NamedTuple):
    """A literal's place and its characters without blanks, line ends and joints."""

    start: int
    end: int
    value: str


def _bare(text: str) -> str:
    """The characters of a literal of several lines, without the lines around a key."""
    lines = [x.strip() for x in text.split("\n")]
    return "".join(x for x in lines if not x.startswith("-----")) if len(lines) > 1 else text.strip()


def _trimmed(text: str, a: int, b: int) -> Literal:
    """The text between a and b without blanks and line ends around it."""
    own = text[a:b]
    left = len(own) - len(own.lstrip())
    return Literal(a + left, max(a + left, a + len(own.rstrip())), _bare(own))


def _block_end(text: str, at: int, line_start: int) -> int:
    """End of the lines from at on that are indented deeper than the line that starts at line_start."""
    indent = len(text) - line_start
    for k in range(line_start, len(text)):
        if text[k] not in " \t":
            indent = k - line_start
            break
    end = at
    while m := _LINE.match(text, end):
        if m[2] and len(m[1]) <= indent:
            break
        end = m.end()
    return end


class Assignments:
    """Name-literal pairs and name-name pairs of a text, found from left to right."""

    def __init__(self, text: str):
        self.literals: dict[str, list[Literal]] = {}
        self.sources: dict[str, set[str]] = {}
        self.text, self.back = text, text[::-1]
        at = block = 0  # ends of the last value and of the last block
        closed = {'"""': True, "'''": True}
        while op := _OPERATOR.search(text, at):
            at = op.end()
            before = _BEFORE.match(self.back, len(text) - op.start())
            if not before:
                continue
            # A name has no digit at its start; a comma stands after a name in quotes, a bracket after a bare one.
            name = before["name"][::-1].lstrip("0123456789.:>-")
            if not name:
                continue
            if not op["set"]:
                quoted = bool(before["shut"]) and before["shut"][0] == before["open"]
                value = _ARGUMENT.match(text, op.end()) if (quoted if op[0] == "," else not before["shut"]) and name_weight(name) else None
                if value:
                    at = self._literal(name, value)
                continue
            value = _VALUE.match(text, op.end())
            if not value:
                continue
            if triple := value["triple"]:
                start = value.end()
                end = self._close(triple, start) if closed[triple] else -1
                if end < 0:
                    closed[triple] = False  # nothing closes it: no later one is read as an opening
                    continue
                self._add(name, _trimmed(text, start, end))
                at = start  # what is inside may hold assignments too
            elif value["block"] is not None:
                if op.start() >= block and op[0] == ":":
                    block = _block_end(text, value.end(), text.rfind("\n", 0, op.start()) + 1)
                    self._add(name, _trimmed(text, value.end(), block))
                at = value.end()
            elif value["text"]:
                at = self._literal(name, value)
            else:
                raw, (a, b) = value["plain"], value.span("plain")
                if _NAME.match(raw):
                    self._source(name, raw)
                if not _NAME.match(raw) or any(c.isdigit() for c in raw):
                    own = raw.rstrip(".")
                    self._add(name, Literal(a, b, own))
                at = b

    def _close(self, triple: str, at: int) -> int:
        """Place of the quotes that close a triple-quoted literal; a backslash takes the next character."""
        end = self.text.find(triple, at)
        while end >= 0:
            slashes = end
            while slashes > at and self.text[slashes - 1] == "\\":
                slashes -= 1
            if (end - slashes) % 2 == 0:
                return end
            end = self.text.find(triple, end + 1)
        return -1

    def _literal(self, name: str, value: re.Match[str]) -> int:
        """Adds a literal with all that is joined to it; returns the end of that."""
        (a, b), raw = value.span("text"), value["text"]
        parts, at = [raw[1:-1]], b
        while raw[0] != "`" and (more := _JOIN.match(self.text, at)):
            if more["text"]:
                parts.append(more["text"][1:-1])
            else:
                self._source(name, more["name"])
            at = more.end()
        self._add(name, Literal(a + 1, at - 1 if at > b and len(parts) > 1 else b - 1, "".join(parts)))
        return at

    def _add(self, name: str, literal: Literal) -> None:
        for key in {name, name.rsplit(".", 1)[-1]}:
            self.literals.setdefault(key, []).append(literal)

    def _source(self, name: str, other: str) -> None:
        for key in {name, name.rsplit(".", 1)[-1]}:
            self.sources.setdefault(key, set()).add(other)

    def weights(self) -> dict[str, int]:
        """How sensitive each name is: by itself, or by a name that gets its value, through any number of names."""
        out: dict[str, int] = {}
        own = {name: name_weight(name) for name in {*self.literals, *self.sources}}
        for w in (3, 2, 1):
            todo = [name for name, x in own.items() if x == w and name not in out]
            while todo:
                name = todo.pop()
                if name not in out:
                    out[name] = w
                    todo += self.sources.get(name, ())
        return out


def named_spans(text: str, least: int = 4) -> list[Span]:
    """Literals whose names and looks together score least or more. A constant that is assigned on to a sensitive name, before or
    after, is reported where it stands."""
    found, best = Assignments(text), {}
    for name, w in found.weights().items():
        for x in found.literals.get(name, ()):
            best[x] = max(best.get(x, 0), w)
    out = set()
    for x, w in best.items():
        looks = literal_weight(x.value) if x.end > x.start else 0
        if looks and w + looks >= least:
            out.add(Span(x.start, 3, x.end))
    return sorted(out)


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those of the lexer, both by start and then kind."""
    base = base_spans(text)
    more = named_spans(text) if any(c in text for c in "=:(,") else []
    return base, sorted(base + more)


def has_quote(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte of a chunk, whether its document has a quotation mark."""
    total = np.concatenate([[0], np.cumsum((buf == 0x22) | (buf == 0x27), dtype=np.int64)])
    return np.repeat(total[off[1:]] > total[off[:-1]], np.diff(off))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, list[Span], list[Span]]]]]:
    """Rows of each chunk with text and spans; whole chunks are searched for cues first, as few texts have any."""
    for batch in batches:
        for rows, buf, off in tk.text_chunks(batch, "text"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            s, e = tk.spans(IS_HEX[buf], off)
            n = len(off) - 1
            hexed, cued, lexed = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
            hexed[np.searchsorted(off, s[e - s >= LEAST_HEX], "right") - 1] = True
            low = tk.LOWER[buf].tobytes()
            for cue in (*CUES, b"akia"):
                p = low.find(cue)
                while p >= 0:
                    k = int(np.searchsorted(off, p, "right")) - 1
                    cued[k] = True
                    p = low.find(cue, int(off[k + 1]))
            # An operator, or a bracket or comma that a quote or white space follows.
            after = np.append(buf[1:], 0x20)
            quote = (after == 0x22) | (after == 0x27) | tk.IS_SPACE[after]
            marks = np.flatnonzero((buf == 0x3D) | (buf == 0x3A) | (((buf == 0x28) | (buf == 0x2C)) & quote & has_quote(buf, off)))
            lexed[np.unique(np.searchsorted(off, marks, "right") - 1)] = True
            out = []
            for k in range(n):
                if not (hexed[k] or cued[k] or lexed[k]):
                    out.append(("", [], []))
                    continue
                text = buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")
                base = base_spans(text, bool(cued[k]), bool(hexed[k]))
                more = named_spans(text) if lexed[k] else []
                out.append((text, base, sorted(base + more) if more else base))
            yield part, out


def scan_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, base_sha256, spans (all spans as kind:start:end in code points, end
    exclusive). Null and empty texts have none; repeated rows get equal results; an empty table gives no row."""
    small_batches(df.sparkSession)

    def run(batches):
        for part, found in _documents(batches):
            count = [[sum(s.kind == k for s in base) for _, base, _ in found] for k in range(3)]
            digest = [hashlib.sha256(",".join(s.show() for s in base).encode()).hexdigest() for _, base, _ in found]
            shown = [",".join(s.show() for s in every) for *_, every in found]
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()), pa.array(shown, pa.string())], ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", id_col)


def mask_text(text: str, spans: list[Span], mark: str) -> str:
    """The text with each union of overlapping spans replaced by mark."""
    out, at = [], 0
    for s in sorted(spans):
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every secret span of text_col replaced by mark; all columns and rows stay, null texts stay null."""
    small_batches(df.sparkSession)
    schema, names = df.schema, df.columns

    def run(batches):
        for batch in batches:
            at = names.index(text_col)
            own = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            masked: list[str | None] = []
            for part, found in _documents(iter([own])):
                for old, (text, _, every) in zip(part.column("text"), found, strict=True):
                    masked.append(mask_text(text, every, mark) if every else old.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(masked, batch.column(at).type) if k == at else batch.column(k) for k in range(len(names))], names=batch.schema.names)

    return df.mapInArrow(run, schema)
