"""Licence tags and notices: one Aho-Corasick pass finds them, a shunting-yard parser evaluates tagged expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.frames import pieces, texts_of

#: The phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of our own, as words, and the identifier that each stands for.
NOTICES = {
    "mit license": "mit", "apache license version 2 0": "apache-2.0", "apache license": "apache", "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause", "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd", "creative commons zero": "cc0", "public domain": "public-domain", "isc license": "isc", "boost software license": "bsl-1.0",
    "eclipse public license": "epl", "permission is hereby granted free of charge": "mit",
}
TAG = "spdx license identifier"
TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
PERMISSIVE = frozenset(["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1.0", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib", "0bsd"])
STRENGTH = {"tag": 1.0, "notice": 0.9, "base": 0.6}
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """The longest leading well-formed expression in postfix order; None if there is none or its brackets don't close."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    place = 0
    for m in _TOKEN.finditer(expression):
        token = m[0]
        if expression[place : m.start()].strip():
            break
        if operand:
            if token == "(":
                stack.append(token)
            elif token in BINDS or token == ")":
                return None
            else:
                out.append(token)
                operand = False
        elif token in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
        place = m.end()
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(order: list[str]) -> tuple[set[str], bool]:
    """(licence identifiers, whether a permissive choice exists): `or` needs one side, `and` both, `with` the licence's own answer."""
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token not in BINDS:
            stack.append(({token}, token.rstrip("+") in PERMISSIVE))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        stack.append((left if token == "with" else left | right, l if token == "with" else l or r if token == "or" else l and r))
    return stack[0]


@lru_cache(maxsize=1)
def automaton():
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: bytes) -> tuple:
    """The result's columns of one text, after doc_id."""
    words = text.translate(_WORDS).split()
    spaced = b" " + b" ".join(words) + b" "
    found = [(end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(spaced.decode("latin-1"))]
    if not found:
        return len(words), 0, None, None, "", "", 0.0, None, None
    starts = [start for start, phrase in found if phrase in BASE]
    # a place's word number is the number of separators before it
    places = np.searchsorted(np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32), starts).tolist() if starts else []
    base = {BASE[p] for _, p in found if p in BASE}
    labels = base | {NOTICES[p] for _, p in found if p in NOTICES}
    score = max(STRENGTH["base"] * bool(base), STRENGTH["notice"] * any(p in NOTICES for _, p in found))
    expressions, permissive = [], None
    if any(p == TAG for _, p in found):
        for m in TAGGED.finditer(text.translate(_LOWER).decode("utf-8", "replace")):
            if (order := postfix(m[1])) is not None:
                ids, free = evaluate(order)
                labels |= ids
                permissive = free if permissive is None else permissive and free
                expressions.append(" ".join(order))
                score = STRENGTH["tag"]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(expressions) or None, permissive


FOUND = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("permissive", pa.bool_())]


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text): counts and places of notices, labels, a score, tagged expressions.

    n_base counts every place of a contract phrase; first_word and last_word are the least and largest of their word
    numbers, null without any. labels adds those of further notices and of tagged expressions (expressions: in postfix
    order; permissive: whether each allows a permissive choice, null without a tag that parses). score is that of the
    strongest evidence, 0 without any. A null text is an empty one; a null doc_id stays null; repeated rows come out as
    often as they come in; an empty table gives an empty result; more columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *FOUND])

    def apply(batches):
        for rows, raw, at in pieces(batches):
            blob = raw.tobytes()
            own = [scan(blob[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, t) for x, (_, t) in zip(zip(*own, strict=True), FOUND, strict=True))], schema=schema)

    return texts_of(docs).mapInArrow(apply, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean")
