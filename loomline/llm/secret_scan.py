"""Secrets in texts: fixed patterns, and literals assigned to sensitive names.

The base patterns are searched everywhere.  The lexer adds to them: it reads name-literal pairs of source code and configuration syntax
(``=``, ``:``, ``:=``, ``=>``, subscripts, calls with a name and a value, command-line options, XML-like tags; strings with prefixes, escapes,
either quote, triple quotes and concatenation; bare literals).  A name may stand for a literal that is bound before or after it, directly or
through other names.  A literal is scored by how sensitive the words of all its target names are and how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# The base patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as [0-9a-f]+ of 32 or more: a shorter run fails at each of its places
KINDS = ("assign", "access", "hex", "literal")

#: name and operator, of any length and spacing, or a quoted name before a quoted value.  Quantifiers are possessive or end at a character that starts no second try, so that a text is read in linear time.
HEAD = re.compile(r"""(?<![A-Za-z0-9_.-])(?:--?|<|["'])?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?:["']?\]?[ \t]*+(?::=|=>|[:=>])[ \t]*+|["'][ \t]*+,[ \t]*+(?=["']))""", re.A)
#: A type or a further name before the operator of the literal: ``str =``, ``Optional[str] =``, ``str | None =``.
INDEX = r"(?:[ \t]*+\[(?:[^][\n]|\[[^][\n]*+\])*+\])?+"
TYPED = re.compile(rf"(?P<type>[A-Za-z_][A-Za-z0-9_.]*+){INDEX}(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+{INDEX})*+[ \t]*+:?=(?![=>])[ \t]*+", re.A)
#: Names without spaces between them and a quoted literal.
CHAIN = re.compile(r"""(?:[A-Za-z_][A-Za-z0-9_.]*+=)++(?=["'])""", re.A)
#: A string: prefix, either quote, escapes; triple quotes over lines.  Bare literals end at white space or punctuation.
STRING = re.compile(r"""(?:[bfruBFRU]{1,2}(?=["']))?(?:(?P<t>"{3}|'{3})(?P<triple>(?s:(?:\\.|(?!(?P=t))[^\\])*+))(?P=t)|(?P<q>["'])(?P<quoted>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q))""", re.A)
#: What joins strings to one literal: an operator, a continued line, or nothing.
JOIN = re.compile(r"""[ \t]*+(?:[+.&][ \t]*+(?:\\?\n[ \t]*+)?|\\\n[ \t]*+)?(?=[bfruBFRU]{0,2}["'])""", re.A)
BARE = re.compile(r"[A-Za-z0-9+/_.=@$%^&*!~-]++", re.A)
INNER = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*+)=(?!=)", re.A)
OPERATOR = re.compile(r"[ \t]*+[:=>]")
MARK = re.compile(r"[:=>]")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weights of words in a target name.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "credential": 3, "credentials": 3, "apikey": 3,
    "auth": 2, "authorization": 2, "bearer": 3, "private": 2, "signing": 2, "encryption": 2, "access": 1, "api": 1, "key": 2, "salt": 2, "session": 1, "cert": 1,
}
HARMLESS = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|example|changeme|your[_-].*|x{3,}|\*+|\$\{.*|\{\{.*|<.*|%.*%|env[.(].*|os[.]environ.*)$")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.A)
#: Least score of a literal that is reported, its least length, and that of one without digits.
LEAST_SCORE, LEAST_LENGTH, LEAST_PHRASE = 3.5, 8, 16

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def entropy(literal: str) -> float:
    """Bits a character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values())


def name_weight(name: str) -> float:
    return max((SENSITIVE.get(w.lower(), 0) for w in WORD.findall(name)), default=0) if name else 0


def literal_score(literal: str, weight: float, quoted: bool = True) -> float:
    """Sensitivity of the names a literal is bound to, plus its variety; zero for placeholders and plain words.

    A literal without digits counts if it is quoted, is one word of two kinds of characters and has some length, and its name is of the most sensitive.
    """
    if len(literal) < LEAST_LENGTH or HARMLESS.match(literal) or not weight:
        return 0.0
    classes = sum(bool(re.search(c, literal)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if classes < 2 or not re.search("[0-9]", literal) and not (quoted and weight >= 3 and len(literal) >= LEAST_PHRASE and not re.search(r"\s", literal)):
        return 0.0
    return weight + entropy(literal) / 2


class Bindings:
    """Names and what they are bound to, a literal or another name, at places of a text."""

    def __init__(self):
        self.literals: dict[tuple[int, int], tuple[str, bool]] = {}
        self.all: list[tuple[list[str], tuple[int, int] | None, str]] = []
        self.of: dict[str, list[int]] = {}

    def add(self, names: list[str], span: tuple[int, int], value: str, quoted: bool, refers: bool) -> float:
        """Bind ``names`` to the literal at ``span``, or to the name ``value`` that stands there."""
        self.literals[span] = (value, quoted)
        for n in names:
            self.of.setdefault(n, []).append(len(self.all))
        self.all.append((names, span, value if refers else ""))
        return max(map(name_weight, names))

    def _next(self, i: int) -> int | None:
        """The binding that binding ``i`` refers to: the last one of its name before it, or else the first after it."""
        places = self.of.get(self.all[i][2]) if self.all[i][2] else None
        if not places:
            return None
        at = bisect_left(places, i)
        return places[at - 1] if at else places[0]

    def spans(self) -> list[tuple[int, int, int]]:
        weight: dict[tuple[int, int], float] = {}
        end: dict[int, int] = {}  # of each binding, the one that has its literal
        for i, (names, _, _) in enumerate(self.all):
            path, at = [], i
            while at not in end:
                end[at] = at  # for now: names that stand for each other end where they meet
                path.append(at)
                if (following := self._next(at)) is None:
                    break
                at = following
            for x in path:
                end[x] = end[at]
            span = self.all[end[i]][1]
            weight[span] = max(weight.get(span, 0), *map(name_weight, names))
        return sorted((a, 3, b) for (a, b), w in weight.items() if w and literal_score(self.literals[a, b][0], w, self.literals[a, b][1]) >= LEAST_SCORE)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals bound, directly or through constants, to sensitive names; of joined strings, from the first to the last."""
    found, at = Bindings(), 0
    while m := HEAD.search(text, at):
        names, at = [m["name"]], m.end()
        while (t := TYPED.match(text, at)) and (text[t.end("type")] != "=" or text[t.end() : t.end() + 1] in ('"', "'")):
            names.append(t["type"])
            at = t.end()
        if chain := CHAIN.match(text, at):
            names += chain[0].split("=")[:-1]
            at = chain.end()
        if q := STRING.match(text, at):
            parts = [q.span("triple" if q["t"] else "quoted")]
            at = q.end()
            while (j := JOIN.match(text, at)) and (q := STRING.match(text, j.end())):
                parts.append(q.span("triple" if q["t"] else "quoted"))
                at = q.end()
            found.add(names, (parts[0][0], parts[-1][1]), "".join(text[a:b] for a, b in parts), True, False)
        elif b := BARE.match(text, at):
            name = NAME.match(b[0])
            if name and OPERATOR.match(text, b.end()):
                continue  # itself a name with a literal
            w = found.add(names, b.span(), b[0], False, bool(name))
            while not w and (inner := INNER.match(text, at, b.end())) and inner.end() < b.end():
                at = inner.end()
                w = found.add([inner[1]], (at, b.end()), text[at : b.end()], False, False)
            at = b.end()
    return found.spans()


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and literals that no base span covers."""
    base = base_spans(text)
    found = literal_spans(text) if MARK.search(text) else []
    return base, [s for s in found if not any(a < s[2] and s[0] < b for a, _, b in base)]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: counts, digest of the base spans, all spans (code points, end exclusive).

    Null or empty texts have none; repeated rows are scanned each; a null doc_id stays null; other columns are not read.
    One pass, no shuffle; memory is one Arrow batch.
    """

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = scan_text(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
