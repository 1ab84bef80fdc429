"""Secret scans: base patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer reads name-literal pairs: ``name = "literal"`` (also in triple quotes, in parts joined by +, or behind := and
=>), ``name: literal``, JSON members, ``export NAME=literal``, ``set name literal``, XML attributes and elements, and
YAML blocks; a comparison is no assignment. It follows names that stand for constants (``KEY = "..."`` then ``password
= KEY``; a name assigned more than once stands for all its values) and scores each literal by how sensitive its target
names are against the bits that its signs hold: the more sensitive the name, the fewer bits do. A bare word without a
digit is a literal only as the whole value of a configuration line, and a quoted sentence without a digit only under a
name for phrases.

Defined results: a null or empty text has no span; texts are scanned whole; equal texts give equal spans; an empty
table gives no rows; extra columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, texts

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "lexed")
#: Parts of a target name and how sensitive they are.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "apikey": 3, "privatekey": 3, "accesskey": 3,
    "token": 2, "credential": 2, "credentials": 2, "auth": 2, "authorization": 2, "bearer": 2, "signature": 1, "key": 1, "pass": 1, "pin": 1,
}
#: Literals that stand for no secret.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|required|optional|string|change_?me|example|placeholder|your[_-].*|<.*>|\$\{.*\}|\$\w+|\{\{.*\}\}|%\(.*\)s|[a-z]+://\S*)$")
#: Bits that a literal needs by its name's sensitivity: quoted or marked otherwise, and bare.
BITS = {3: (18, 30), 2: (28, 40), 1: (48, 56)}
_QUOTED = r"""[bru]{0,2}(?:(?P<triple>\"{3}|'{3})(?P<block>.*?)(?P=triple)|(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote))"""
_PAIR = re.compile(
    r"""(?<![\w.$-])(?:(?:export|set|const|let|var|final|static|string|str|define)[ \t]+){0,4}["']?(?P<name>[A-Za-z_$][\w.$-]*+)["']?[ \t]*(?P<op>:=|=>|=(?!=)|:(?!:))[ \t]*"""
    rf"""(?:{_QUOTED}|(?P<bare>[^\s"'`,;(){{}}\[\]<>#=][^\s"'`,;(){{}}\[\]<>#]*))""", re.ASCII | re.S)
#: The next part of a literal that is joined by +.
_MORE = re.compile(r"""\s*\+\s*(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)""")
_SET = re.compile(r"""^[ \t]*set(?:env)?[ \t]+(?P<name>[A-Za-z_][\w.-]*+)[ \t]+(?P<quote>["']?)(?P<value>[^\s"'=:]++)(?P=quote)[ \t]*$""", re.M | re.ASCII)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*)?>\s*(?P<value>[^<>\s](?:[^<>]*[^<>\s])?)\s*</(?P=name)\s*>", re.ASCII)
_BLOCK = re.compile(r"""^(?P<indent>[ ]*+)(?:- )?["']?(?P<name>[A-Za-z_][\w.-]*+)["']?[ ]*:[ ]*[|>][+-]?\d?[ ]*\n(?P<value>(?:(?P=indent)[ ]+[^ \n][^\n]*(?:\n|\Z))+)""", re.M | re.ASCII)
#: What stands before a pair and after it on a configuration line.
_BEFORE = re.compile(r"[ \t]*(?:export[ \t]+|-[ \t]+)?")
_AFTER = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\r?\n|\Z)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> int:
    parts = [p.lower() for p in _PARTS.findall(name)]
    both = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0) for p in parts + both), default=0)


def bits(literal: str) -> float:
    """Bits that the literal's signs hold by their own distribution, a quarter more for every class of signs beyond the first."""
    n = len(literal)
    held = -sum(c * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0
    classes = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search("[0-9]", literal), re.search(r"[^A-Za-z0-9\s]", literal))))
    return held * (1 + 0.25 * max(0, classes - 1))


def secret(literal: str, weight: int, marked: bool, whole: bool, phrase: bool) -> bool:
    """Whether a literal under a name of this sensitivity is a secret.

    marked: by quotes or an element; whole: the whole value of a configuration line; phrase: the name is for phrases.
    """
    digit = re.search(r"[0-9]", literal) is not None
    if PLACEHOLDERS.match(literal) or (marked and not digit and not phrase and re.search(r"\s", literal)) or (not marked and not digit and not whole):
        return False
    return bits(literal) >= BITS[weight][not marked]


def reached(names: list[str], edges: dict, seen: set[str]) -> set[str]:
    """The names and all that edges lead to from them, without those seen before; adds them to seen."""
    todo, out = list(names), set()
    while todo:
        if (name := todo.pop()) not in seen:
            seen.add(name)
            out.add(name)
            todo += edges.get(name, ())
    return out


def pairs(text: str) -> list[tuple[str, str, tuple[tuple[int, int], ...], bool, bool]]:
    """(name, literal, its parts' places, whether quotes or the like mark it, whether it is a configuration line's value)."""
    out = []
    for m in _PAIR.finditer(text):
        if m["bare"] is not None:
            before = text[max(0, m.start() - 200) : m.start()].rpartition("\n")[2]
            tight = m["op"] == ":" or text[m.start("op") - 1] not in " \t" and text[m.end("op")] not in " \t"
            whole = tight and len(before) < 200 and _BEFORE.fullmatch(before) is not None and _AFTER.match(text, m.end()) is not None
            out.append((m["name"], m["bare"], (m.span("bare"),), False, whole))
            continue
        group = "block" if m["triple"] else "quoted"
        value, places, at = m[group], [m.span(group)], m.end()
        while more := _MORE.match(text, at):
            value, at = value + more["quoted"], more.end()
            places.append(more.span("quoted"))
        out.append((m["name"], value, tuple(places), True, False))
    if "set" in text:
        out += [(m["name"], m["value"], (m.span("value"),), bool(m["quote"]), True) for m in _SET.finditer(text)]
    if "</" in text:
        out += [(m["name"], m["value"], (m.span("value"),), True, False) for m in _ELEMENT.finditer(text)]
    if "|" in text or ">" in text:
        for m in _BLOCK.finditer(text):
            value = m["value"]
            start = m.start("value") + len(value) - len(value.lstrip())
            out.append((m["name"], "".join(value.split()), ((start, m.start("value") + len(value.rstrip())),), True, False))
    return out


def lex(text: str) -> list[tuple[int, int]]:
    """Places of the literals that are secrets by their targets."""
    found = pairs(text)
    names = {name for name, *_ in found}
    constants: dict[str, list[tuple]] = {}
    stands_for: dict[str, set[str]] = {}
    for name, value, places, marked, whole in found:
        if not marked and value in names:
            if value != name:
                stands_for.setdefault(name, set()).add(value)
        else:
            constants.setdefault(name, []).append((value, places, marked, whole))
    out: set[tuple[int, int]] = set()
    seen: set[str] = set()
    for weight in sorted(BITS, reverse=True):
        mine = [name for name in names if sensitivity(name) == weight]
        for start in mine:  # of a name that several targets lead to, the most sensitive one counts
            phrase = "phrase" in start.lower()
            for name in reached([start], stands_for, seen if not phrase else set()):
                for value, places, marked, whole in constants.get(name, ()):
                    if secret(value, weight, marked, whole, phrase):
                        out.update(places)
    return sorted(out)


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a number, end) of every span, in order."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text or "set" in text:
        found += [(a, 3, b) for a, b in lex(text)]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts by kind, base_sha256 and spans."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        all_spans = [spans(t) for t in texts(b.column("text"))]
        base = [[s for s in x if s[1] < 3] for x in all_spans]
        count = lambda k: pa.array([sum(s[1] == k for s in x) for x in all_spans], pa.int64())
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), count(0), count(1), count(2), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in all_spans], pa.string()), count(3)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])

    return by_batch(documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redacted(text: str, mark: str = "[secret]") -> str:
    """text with every maximal run of overlapping spans replaced by mark; of an assignment only the literal goes."""
    out, at = [], 0
    for start, kind, end in spans(text):
        if kind == 0:
            m = ASSIGN.match(text, start)
            start = m.start(2)
        start = max(start, at)
        if end > at:
            out += [text[at:start], mark] if start > at or not out else []
            at = end
    return "".join(out) + text[at:] if out else text


def redact(documents: DataFrame) -> DataFrame:
    """documents with their secrets replaced; a null text stays null, and n_chars follows the text."""
    names = documents.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        old = b.column("text").to_pylist()
        new = [x and redacted(x) for x in old]
        columns = list(b.columns)
        columns[names.index("text")] = pa.array(new, pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            columns[i] = pa.array([c if x == y else len(y) for x, y, c in zip(old, new, columns[i].to_pylist(), strict=True)], columns[i].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return by_batch(documents, run, documents.schema)
