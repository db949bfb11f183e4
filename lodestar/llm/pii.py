"""Personal data and secrets in whole texts: fixed patterns, and what a conditional random field labels from shapes and context."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.crf import KINDS as ADDED
from lodestar.llm.crf import Field, tagged
from lodestar.llm.frames import pieces, small_batches, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *ADDED)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that no address starts with is taken whole: no later start within it could match either.
_IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match has its one @ after the run of local characters that ends there, so each @ is tried once."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans in code points of each kind of BASE."""
    mail = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return [mail, [], [], []]
    ip = [m.span() for m in _IP.finditer(text) if m[1] and all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[1].split("."))] if text.count(".") > 2 else []
    card = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 15 and 16 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15] if "+" in text else []
    return [mail, ip, card, phone]


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field().fit()


def _joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=False) for a, b in own)


def find(field: Field, texts: list[str], raw, at) -> list[list[list[tuple[int, int]]]]:
    """For each text the spans of each kind of KINDS; those of the field that meet a base span are left out."""
    out = [[*base_spans(t), *([] for _ in ADDED)] for t in texts]
    for i, kind, a, b in tagged(field, raw, at):
        a, b = a - int(at[i]), b - int(at[i])
        if len(texts[i]) != at[i + 1] - at[i]:
            own = raw[at[i] : at[i + 1]].tobytes()
            a, b = len(own[:a].decode()), len(own[:b].decode())
        if not any(x < b and a < y for spans in out[i][:4] for x, y in spans):
            out[i][KINDS.index(kind)].append((a, b))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans, redacted: a row for each row of docs(doc_id, text).

    The four counts and base_sha256 are of the base patterns; n_added counts the spans of the kinds tel, id and secret,
    which only the field finds, and spans has them too.
    redacted is the text with each span as <kind>, where spans overlap as one. A null text is an empty one and redacted
    then null; a null doc_id stays null; repeated rows come out as often as they come in; an empty table gives an empty
    result; more columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in (*BASE, "added")), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])
    field = trained()

    def apply(batches):
        for rows, raw, at in pieces(batches):
            given = rows.column(1).to_pylist()
            texts = [t or "" for t in given]
            found = find(field, texts, raw, at)
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in range(4)]
            counts.append(pa.array([sum(map(len, f[4:])) for f in found], pa.int64()))
            digests = [hashlib.sha256(_joined(f[:4]).encode()).hexdigest() for f in found]
            spans = [_joined(f) for f in found]
            clean = [None if t is None else redact(t, f) for t, f in zip(given, found, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(clean, pa.string())], schema=schema)

    return texts_of(docs).mapInArrow(apply, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, redacted string")


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns; text has each span replaced, and n_chars is then that of the new text.

    Null texts, null ids, repeated rows and other columns stay as they are; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    field = trained()

    def apply(batches):
        for rows, raw, at in pieces(batches):
            given = rows.column(rows.schema.get_field_index("text")).to_pylist()
            clean = [None if t is None else redact(t, f) for t, f in zip(given, find(field, [t or "" for t in given], raw, at), strict=True)]
            columns = dict(zip(rows.schema.names, rows.columns, strict=True))
            columns["text"] = pa.array(clean, rows.schema.field("text").type)
            if "n_chars" in columns:
                n = [len(c) if c != t else k for c, t, k in zip(clean, given, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(n, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(apply, docs.schema)


def redact(text: str, found: list[list[tuple[int, int]]]) -> str:
    every = sorted((a, b, kind) for kind, own in zip(KINDS, found, strict=True) for a, b in own)
    if not every:
        return text
    out, end = [], 0
    for a, b, kind in every:
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])
