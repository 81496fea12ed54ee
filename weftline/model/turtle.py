"""Reader for the part of Turtle that schema ontologies use.

Directives ``@prefix`` and ``@base``, comments, IRIs, prefixed names, ``a``, predicate and object lists, quoted strings (short
and long) with escapes, language tags and datatypes, numbers and booleans, collections and
blank nodes.  Triples come out as (subject, predicate, object), where literals are ``Literal``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import count

from ..errors import OntologyError

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NIL, FIRST, REST, TYPE = RDF + "nil", RDF + "first", RDF + "rest", RDF + "type"


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = ""
    lang: str = ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})
    |(?P<string>"(?:[^"\\\n]|\\.)*")
    |(?P<directive>@prefix\b|@base\b|(?:PREFIX|BASE)\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<datatype>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<blank>_:[\w-]+)
    |(?P<name>(?:[^\W\d][\w.-]*)?:(?:[\w-](?:[\w.-]*[\w-])?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>[.;,()\[\]])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def _unquote(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES.get(m[1], m[1]), text)


def _tokens(text: str):
    at, line = 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise OntologyError(f"line {line}: can't read {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            yield m.lastgroup, m[0], line
        line += m[0].count("\n")
        at = m.end()
    yield "end", "", line


class _Parser:
    def __init__(self, text: str):
        self.tokens = list(_tokens(text))
        self.at, self.base, self.prefixes, self.triples, self.blanks = 0, "", {}, [], count()

    def peek(self) -> str:
        kind, text, _ = self.tokens[self.at]
        return text if kind == "mark" else kind

    def take(self, *wanted: str) -> str:
        kind, text, line = self.tokens[self.at]
        if wanted and kind not in wanted and text not in wanted:
            raise OntologyError(f"line {line}: expected {' or '.join(wanted)}, found {text or 'the end'!r}")
        self.at += 1
        return text

    def fresh(self) -> str:
        return f"_:b{next(self.blanks)}"

    def document(self):
        while self.peek() != "end":
            if self.peek() == "directive":
                self.directive()
            else:
                alone = self.peek() == "["
                subject = self.term()
                if not (alone and self.peek() == "."):
                    self.predicates(subject, ".")
                self.take(".")
        return self.triples, self.prefixes

    def directive(self):
        word = self.take()
        if word.lower().endswith("prefix"):
            name = self.take("name")
            if not name.endswith(":"):
                raise OntologyError(f"a prefix must end with a colon: {name}")
            self.prefixes[name[:-1]] = self.iri(self.take("iri"))
        else:
            self.base = self.iri(self.take("iri"))
        if word.startswith("@"):
            self.take(".")

    def iri(self, text: str) -> str:
        inner = text[1:-1]
        return inner if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", inner) else self.base + inner

    def predicates(self, subject, end: str):
        while self.peek() != end:
            predicate = self.term()
            while True:
                self.triples.append((subject, predicate, self.term()))
                if self.peek() != ",":
                    break
                self.take(",")
            if self.peek() != ";":
                break
            while self.peek() == ";":
                self.take(";")

    def term(self):
        kind, text, line = self.tokens[self.at]
        self.at += 1
        if kind == "iri":
            return self.iri(text)
        if kind == "name":
            prefix, _, rest = text.partition(":")
            if prefix not in self.prefixes:
                raise OntologyError(f"line {line}: unknown prefix {prefix!r}")
            return self.prefixes[prefix] + rest
        if kind == "blank":
            return text
        if kind in ("string", "long"):
            value = _unquote(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek() == "lang":
                return Literal(value, lang=self.take()[1:])
            if self.peek() == "datatype":
                self.take()
                return Literal(value, datatype=self.term())
            return Literal(value)
        if kind == "number":
            return Literal(text, "http://www.w3.org/2001/XMLSchema#" + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if text == "a":
            return TYPE
        if text in ("true", "false"):
            return Literal(text, "http://www.w3.org/2001/XMLSchema#boolean")
        if text == "[":
            node = self.fresh()
            self.predicates(node, "]")
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek() != ")":
                items.append(self.term())
            self.take(")")
            nodes = [self.fresh() for _ in items] + [NIL]
            for i, item in enumerate(items):
                self.triples += [(nodes[i], FIRST, item), (nodes[i], REST, nodes[i + 1])]
            return nodes[0]
        raise OntologyError(f"line {line}: unexpected {text or 'end of file'!r}")


def parse(text: str) -> tuple[list[tuple], dict[str, str]]:
    """Triples in order and the prefixes."""
    return _Parser(text.removeprefix("﻿")).document()
