"""Secret scans by assignment-aware lexing.

Three base patterns give spans of the kinds assign, access and hex. Beside them, source and configuration syntax is lexed
into pairs of a name and an expression of literals and other names: assignments (also of lists and with types), mappings with
the value behind the name or on the next line, definitions and options of commands, arguments behind a name, subscripts,
attributes and elements of tags, logins in addresses. Constants are propagated from name to
name, and a literal scores by the most sensitive name that it reaches and by its own form. Literals that score enough are
spans of the kind named. The inside of each literal is lexed once more, for connection strings, options and JSON in
strings. Spans count code points, ends exclusive.

The text is walked once from operator to operator: a name is looked for between the operator before it and its own, and a
value behind it, so names, values and the blanks around them may be of any length, and time grows with the text's length.

Null texts count as empty and have no spans. Every row is scanned by itself, so repeated rows and ids repeat their
result; other columns than doc_id and text are not read. Names of equal score are gone through in falling order. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foldwise.llm.common import text_batches, unwrapped, wrapped

KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Runs that are long enough; shorter ones hold no long one, so nothing else is found than by taking all runs.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_SCORE = 6, 0.5
#: Bits from which a literal is varied enough; a phrase's least length and form.
ENOUGH_BITS, LEAST_PHRASE = 20, 12
PHRASE = re.compile(r"[a-z0-9]+(?:[ _-][a-z0-9]+){2,7}")

OPERATOR = re.compile(r":=|=>|<-(?=[ \t])|(?<![=!<>+*/%&|^-])=(?![=>])|:(?![:=/\\])")
#: The characters of a name that ends before an operator, read backwards.
NAME_BACK = re.compile(r"[A-Za-z0-9_.$-]+")
TERM = re.compile(r"""(?:([rbuf]{0,2})("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|(\$\{?[A-Za-z_]\w*\}?|[A-Za-z_][\w.]*(?![\w+/=-]))|([^\s"'`#;,(){}\[\]<>]+))""")
BLANKS = re.compile(r"[ \t]*")
#: Where a value starts on the next line; there without quotes it is a line of its own and no name.
NEXT_LINE = re.compile(r"(?:[|>][+-]?[ \t]*)?\r?\n[ \t]+")
LINE_VALUE = re.compile(r"""([^\s"'`#;,:(){}\[\]<>]+)[ \t]*(?=\r?\n|\Z)""")
TRIPLE = re.compile(r"""[rbuf]{0,2}(\"{3}|'{3})""")
#: A scheme of an authorization and its value.
SCHEME = re.compile(r"""(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]+([A-Za-z0-9+/_.=~-]+)""")
#: A value inside a literal; without quotes it ends at separators.
INNER = re.compile(r"""[ \t]*(?:\\?"([^"\\\n]*)|\\?'([^'\\\n]*)|([^\s"'`;&,\\(){}\[\]<>]+))""")
TAG = re.compile(r"<([A-Za-z][\w.:-]*+)([^<>]*+)>([^<>]*+)")
ATTRIBUTE = re.compile(r"""(?<![\w.:-])([A-Za-z_][\w.:-]*+)[ \t\r\n]*+=[ \t\r\n]*+(?:"([^"]*+)"|'([^']*+)')""")
#: A name that a command, a definition or an option sets to what follows, and one that a call gets as its argument before another.
COMMAND = re.compile(r"""(?:^[ \t]*+(?:\#[ \t]*+define|setenv|ENV|ARG)[ \t]++|(?<![\w-])--)([A-Za-z_][\w-]*+)[ \t]++(?=[\w"'`])""", re.M)
ARGUMENT = re.compile(r"""\([ \t]*+(?:"([\w.-]++)"|'([\w.-]++)')[ \t]*+,""")
#: A list of values opens; the next value of one; what makes a value a name of its own.
OPENS, NEXT, NAMES = re.compile(r"""[ \t]*+[\[{(][ \t\r\n]*+(?=[rbuf]{0,2}["'`])"""), re.compile(r"[ \t]*+,[ \t\r\n]*+(?=\S)"), re.compile(r"[ \t]*+(?::|=>)")
LOGIN = re.compile(r"""://[^\s/:@"'<>]*:([^\s/:@"'<>]+)@""")
JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\|\||\?\?|or\b)[ \t]*(?=\S)")
#: A word that may be a value and no name: two digits and more beside letters.
DIGITS_IN = re.compile(r"[0-9][^0-9]*[0-9]")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|todo|change_?me|example|your[_-].*|<.*>|\$\{.*\}|%.*%|test|dummy|placeholder|string|text|bool(?:ean)?|int(?:eger)?|required|optional|default|secret|password|value|empty|hidden|enabled|disabled)$")
#: What a text has that has a name with a value.
MARKS = ("=", ":", "</", "<-", "--", "define", "setenv", "ENV", "ARG", '("', "('")
#: How sensitive the parts of a name are, and parts that make it harmless.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 0.9, "token": 0.8, "apikey": 0.95,
             "key": 0.5, "api": 0.3, "private": 0.5, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "authorization": 0.8, "access": 0.3, "bearer": 0.8, "signing": 0.4}
HARMLESS = {"length", "len", "count", "size", "hint", "url", "uri", "path", "file", "name", "type", "policy", "field", "label", "public", "min", "max", "expiry", "ttl"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap in each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    if HARMLESS.intersection(parts):
        return 0.0
    return 1 - math.prod(1 - SENSITIVE.get(p, 0.0) for p in parts)


def literal_score(text: str, quoted: bool = True) -> float:
    """How much a literal looks like a secret: bits of its characters' distribution, kinds of characters, no placeholder."""
    if len(text) < LEAST_VALUE or PLACEHOLDER.match(text):
        return 0.0
    if any(c.isspace() for c in text):  # a phrase of a few plain words
        return 0.7 if quoted and len(text) >= LEAST_PHRASE and PHRASE.fullmatch(text) else 0.0
    n = len(text)
    bits = sum(c * math.log2(n / c) for c in Counter(text).values())
    classes = sum(map(bool, (re.search("[a-z]", text), re.search("[A-Z]", text), re.search("[0-9]", text), re.search("[^A-Za-z0-9]", text))))
    return min(1.0, bits / ENOUGH_BITS) * ((0.7 if quoted or classes > 1 else 0.3) + 0.1 * classes)


def name_before(text: str, start: int, end: int) -> str:
    """The name that ends at ``end`` but for blanks, quotes and a subscript; in a["name"] it is the subscript."""
    part = text[start:end].rstrip(" \t")
    if part.endswith("]"):
        at = part.rfind("[")
        inside = part[at + 1: -1].strip(" \t") if at >= 0 else ""
        if len(inside) > 2 and inside[0] in "\"'" and inside[-1] == inside[0]:
            return inside[1:-1]
        part = part[: max(at, 0)].rstrip(" \t")
    if part and part[-1] in "\"'`":
        stop = len(part) - 1
        at = part.rfind(part[-1], 0, stop)
        return part[at + 1: stop].strip("\\") if at >= 0 else ""
    found = NAME_BACK.match(part[::-1])
    return found[0][::-1].lstrip("-.$0123456789") if found else ""


def nested(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of sensitive assignments inside a literal; as values are passed over, each character is read a fixed number of times."""
    done = start
    for m in OPERATOR.finditer(text, start, end):
        if m.start() < done:  # inside a value
            continue
        name = name_before(text, done, m.start())
        value = name_score(name) and INNER.match(text, m.end(), end)
        if value:
            yield name, *value.span(value.lastindex)
        done = value.end() if value else m.end()


class Lexer:
    """Literals and other names by the names that they are assigned to."""

    def __init__(self, text: str):
        self.text, self.literals, self.sources, self.bare = text, defaultdict(list), defaultdict(set), []
        if "<" in text:
            self.tags()
        for m in LOGIN.finditer(text):
            self.literals["password"].append((*m.span(1), True))
        for pattern in (COMMAND, ARGUMENT):
            for m in pattern.finditer(text):
                if name_score(m[m.lastindex]):
                    self.expression(m[m.lastindex], m.end())
        done, last = 0, ("", 0)
        for m in OPERATOR.finditer(text):
            if m.start() >= done:  # not inside a value
                name = name_before(text, max(done, text.rfind("\n", done, m.start()) + 1), m.start())
                if not name and m[0] == "=" and not text[last[1]: m.start()].strip(" \t"):
                    name = last[0]  # a name with a type, and its value behind that
                done = max(m.end(), self.expression(name, m.end()) if name else 0)
                last = (name, done)
        for name, value, start, end in self.bare:  # words that are nobody's name
            if value not in self.literals and value not in self.sources:
                self.literals[name].append((start, end, False))

    def literal(self, name: str, start: int, end: int, quoted: bool) -> None:
        self.literals[name].append((start, end, quoted))
        for inner, a, b in nested(self.text, start, end):
            self.literals[inner].append((a, b, True))

    def tags(self) -> None:
        """<add key="name" value="literal"/>, <name>literal</name> and attributes."""
        for m in TAG.finditer(self.text):
            found = {a[1].lower(): a for a in ATTRIBUTE.finditer(self.text, *m.span(2))}
            named = found.get("key") or found.get("name") or found.get("id")
            if named and "value" in found:
                value = found["value"]
                self.literal(named[named.lastindex], *value.span(value.lastindex), True)
            if name_score(m[1]) and self.text.startswith(f"</{m[1]}>", m.end()):
                self.literal(m[1], *m.span(3), True)

    def expression(self, name: str, at: int) -> int:
        """Takes the literals and names that are joined from ``at`` on; where they end."""
        text, first = self.text, True
        opened = OPENS.match(text, at)
        done = at = opened.end() if opened else BLANKS.match(text, at).end()
        below = NEXT_LINE.match(text, at)
        if below:
            at = below.end()
            if text[at: at + 1] not in {'"', "'"}:
                alone = LINE_VALUE.match(text, at)
                if alone:
                    self.literal(name, *alone.span(1), False)
                return alone.end() if alone else done
        scheme = SCHEME.match(text, at)
        if scheme:
            self.literal(name, *scheme.span(1), True)
            return scheme.end()
        while True:
            triple = TRIPLE.match(text, at)
            end = text.find(triple[1], triple.end()) if triple else -1
            if end >= 0:
                self.literal(name, triple.end(), end, True)
                done = end + 3
            else:
                term = TERM.match(text, at)
                if not term or (term[4] and not first):
                    return done
                done = term.end()
                if term[3]:
                    self.sources[name].add(term[3].strip("${}"))
                    if DIGITS_IN.search(term[3]) and text[done: done + 1] not in {"(", "[", "."} and "$" not in term[3]:
                        self.bare.append((name, term[3], *term.span(3)))
                elif term[2]:
                    if opened and NAMES.match(text, done):
                        return term.start()  # a mapping, which is lexed by its own names
                    self.literal(name, term.start(2) + 1, term.end(2) - 1, True)
                else:
                    self.literal(name, *term.span(4), False)
            joined = JOIN.match(text, done) or (opened and NEXT.match(text, done))
            if not joined:
                return done
            at, first = joined.end(), False


def named_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name, directly or through other names."""
    found = Lexer(text)
    best: dict[str, float] = {}
    for score, name in sorted(((name_score(n), n) for n in {*found.literals, *found.sources}), reverse=True):
        todo = [name] if score else []
        while todo:  # the names whose constants flow into this one; those seen before have a score as high
            at = todo.pop()
            if at not in best:
                best[at] = score
                todo += found.sources.get(at, ())
    return [
        (a, 3, b) for name, spans in found.literals.items() if best.get(name) for a, b, quoted in spans
        if best[name] * literal_score(text[a:b], quoted) >= LEAST_SCORE]


def spans_of(text: str) -> list[tuple[int, int, int]]:
    found = base_spans(text)
    if any(mark in text for mark in MARKS):
        found += named_spans(text)
    return sorted(set(found))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scanned(documents: DataFrame) -> DataFrame:
    """Of each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, also of the method's own kind)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_batches(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = spans_of(text or "")
                kinds = [k for _, k, _ in spans]
                base = joined([s for s in spans if s[1] < 3])
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without_secrets(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by a mark; texts without spans, null ones too, stay as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_batches(batches):
            texts = [x and redacted(x, spans_of(x)) for x in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    rows = wrapped(documents)
    return rows.mapInArrow(clean, rows.schema).select(*unwrapped(documents.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
