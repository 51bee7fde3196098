"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Every scan is linear in the text: each pattern consumes a whole run of its characters,
matched or not, so long runs are never scanned again from their middle.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_TEL = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z-])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Scores: of a pattern's match, what a passed checksum adds, what a context word adds or one that speaks against takes away, and what it takes to count.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.3, "ssn": 0.4, "tel": 0.4}
CHECKSUM, CONTEXT, ACCEPT, NEAR = 0.4, 0.3, 0.6, 48
#: Words that speak for a kind when they stand near a span.
WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
WORDS["tel"] = WORDS["phone"]
#: Words that speak against one when they stand before it.
AGAINST = {
    "iban": ("serial", "tracking", "sku", "isbn", "part"),
    "ssn": ("serial", "tracking", "sku", "isbn", "part", "order", "ticket"),
    "tel": ("serial", "tracking", "sku", "isbn", "part", "order", "ticket", "invoice"),
}


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", re.I)


_NEARBY, _AGAINST = ({k: _any_word(w) for k, w in words.items()} for words in (WORDS, AGAINST))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d // 5 + d * 2 % 10 for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:  # what is left of this @ holds no other, so no later match reaches back over it
            done = at + 1
        at = text.find("@", done)


def _ips(text: str):
    for m in _IP.finditer(text):
        if "." in (whole := m[0]) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in whole.split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                yield m.span()


def _ibans(text: str):
    at = 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        # a run of capitals and digits may end in other words, or in the next account; the account is the longest prefix that checks out
        plain, ends = [], []
        for k in range(start, m.end()):
            if text[k] != " ":
                plain.append(text[k])
                ends.append(k + 1)
        for n in range(min(len(plain), 34), 14, -1):
            stop = ends[n - 1]
            if (stop == len(text) or not text[stop].isalnum()) and mod97("".join(plain[:n])):
                yield start, stop
                at = stop
                break


def _ssns(text: str):
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def _tels(text: str, taken: list[tuple[int, int]]):
    """National numbers of 9 to 11 digits that are part of no other span."""
    taken = sorted(taken)
    k = 0
    for m in _TEL.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 11:
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if all(a >= m.end() for a, _ in taken[k : k + 1]):
                yield m.span()


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind.

    The base kinds are certain: their spans count whatever their score. The others count from ACCEPT on.
    """
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", *s) for s in _ips(text)] + [("card", *s) for s in _cards(text)] + [("phone", *s) for s in _phones(text)]
    found += [("iban", *s) for s in _ibans(text)] + [("ssn", *s) for s in _ssns(text)]
    found += [("tel", *s) for s in _tels(text, [s[1:] for s in found])]
    out = []
    for kind, start, stop in found:
        score = SCORE[kind] + CHECKSUM * (kind in ("card", "iban"))
        around = text[max(0, start - NEAR) : start], text[stop : stop + NEAR]
        score += CONTEXT * any(map(_NEARBY[kind].search, around))
        score -= CONTEXT * (kind in _AGAINST and _AGAINST[kind].search(around[0]) is not None)
        if kind in BASE or score >= ACCEPT:
            out.append((kind, start, stop, round(min(1.0, score), 2)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text), found (array of kind, start, stop, score).

    A null or empty text has no spans: counts 0, spans '', the hash of ''. Null and repeated ids
    pass through, one row each. Other columns are not read. Positions count code points.
    """

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for text in b.column(1):
                spans = find_spans(text.as_py() or "")
                base = [s for s in spans if s[0] in BASE]
                values = [*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                for c, v in zip(cols, [*values, [{"kind": k, "start": a, "stop": e, "score": s} for k, a, e, s in spans]], strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    names = [id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "found"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, found array<struct<kind:string,start:bigint,stop:bigint,score:double>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in brackets; of overlapping spans the first. Null texts stay null."""

    @F.pandas_udf("string")
    def hide(column):
        import pandas as pd

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, start, stop, _ in find_spans(text):
                if start >= at:
                    out += [text[at:start], f"[{kind}]"]
                    at = stop
            return "".join([*out, text[at:]])

        return pd.Series([one(x) for x in column], dtype=object)

    return docs.withColumn(text_col, hide(F.col(text_col)))
