"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
``://`` and cues of identifiers.  From each anchor a local parser expands to the
boundaries of the address or number and validates it.  Anchors inside an accepted
or rejected stretch of the same kind are passed over, so that spans of one kind
never overlap and each parser reads a stretch once.

Kinds: ``email``, ``ip`` (parts up to 255), ``card`` (16 to 19 digits, Luhn),
``phone`` (8 to 15 digits after a plus); and, from schemes and cues,
``credential`` (user information in a URL), ``iban`` (check digits valid) and
``account`` (digits after an account cue).

Defined results: NULL text counts as empty and has no spans; positions are code
points, end exclusive; repeated rows are scanned each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.columns import q

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "credential", "iban", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER_INFO = re.compile(r"([A-Za-z0-9._~!$&'()*+,;=%-]+:[A-Za-z0-9._~!$&'()*+,;=%-]+)@[A-Za-z0-9\[]")
IBAN = re.compile(r"[\x20:#]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"\x20?(?:number|no|nr|id)?[.\x20]?[:#]?\x20?([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])")
CUES = {"iban": ("iban", "IBAN"), "account": ("account", "Account", "ACCOUNT", "acct", "Acct")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Scanner:
    def __init__(self):
        import ahocorasick
        self.anchors = ahocorasick.Automaton()
        for word, what in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in "0123456789")]:
            self.anchors.add_word(word, what)
        for what, words in CUES.items():
            for word in words:
                self.anchors.add_word(word, what)
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """Spans (rank of the kind, start, end), sorted."""
        out: list[tuple[int, int, int]] = []
        email = ip = card = phone = account = 0  # where the next stretch of each kind may start
        for at, what in self.anchors.iter(text):
            if what == "digit":
                if at >= card:
                    card = at + 1
                    if m := CARD.match(text, at):
                        card = m.end()
                        digits = only_digits(m[0])
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            out.append((2, at, card))
                if at >= ip:
                    if m := QUAD.match(text, at):
                        ip = m.end()
                        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                            out.append((1, at, ip))
                    else:
                        ip = DIGITS.match(text, at).end()
            elif what == "at":
                start = at
                while start > email and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    email = m.end()
                    out.append((0, start, email))
            elif what == "plus":
                if at >= phone and (m := PHONE.match(text, at)):
                    phone = m.end()
                    if 8 <= len(only_digits(m[0])) <= 15:
                        out.append((3, at, phone))
            elif what == "scheme":
                if m := USER_INFO.match(text, at + 1):
                    out.append((4, m.start(1), m.end(1)))
            elif what == "iban":
                if (m := IBAN.match(text, at + 1)) and iban_valid(m[1]):
                    out.append((5, m.start(1), m.end(1)))
            elif at >= account and (m := ACCOUNT.match(text, at + 1)):
                account = m.end()
                out.append((6, m.start(1), m.end(1)))
        return sorted(out)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = Scanner()
    for b in batches:
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in scan(t.as_py() or "")] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end; by kind as listed, then start) of every text."""
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text"))
    return rows.mapInArrow(_scan_batches, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
