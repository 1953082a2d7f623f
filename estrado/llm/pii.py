"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits followed by a dot, digits, cues of
account identifiers and of secrets. Around an anchor a deterministic parser expands the span to its bounds and validates it: by check digits
where an identifier has them, by its form where it has not. Spans of
a kind are leftmost and don't overlap; a span that fails its check is dropped and not tried again at a later start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streams import small_batches

#: The kinds in the order in which spans at one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = 4
#: Schemes that open an address, cues before an account identifier, cues before a secret, and what keys of some services begin with.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "passport", "ssn")
SECRETS = ("token", "api key", "api_key", "api-key", "apikey", "secret", "password", "passwd", "access key", "access_key", "private key", "private_key", "bearer")
PREFIXES = {"akia": re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), "ghp_": re.compile(r"ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), "sk-": re.compile(r"sk-[A-Za-z0-9_-]{20,}")}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
SAID = re.compile(r"((?:[\x20]*(?:no\.?|number|id|[:#=-])){0,3})[\x20]*", re.IGNORECASE)
#: Eight digits that are a date, year first or last.
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])(?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:19|20)[0-9]{2}")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){11,30}")
FORMS = {
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}[\x20-]?(?!00)[0-9]{2}[\x20-]?(?!0000)[0-9]{4}(?![A-Za-z0-9])"),
    "passport": re.compile(r"[A-Za-z]{0,2}[0-9]{6,9}(?![A-Za-z0-9])"),
    "account": re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![A-Za-z0-9])"),
}
FORMS["acct"] = FORMS["account"]
SECRET = re.compile(r"(?:[_-]?(?:id|value))?[\x20]*[\"']?[\x20]*(?:[:=]|is|->|=>)?[\x20]*[\"']?([A-Za-z0-9+/_=.~-]{16,})")
DIGITS = frozenset("0123456789")
DOTS = DIGITS | {"."}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("+", "+")
    for d in "0123456789":
        a.add_word(d, "d")
    for words, what in ((SCHEMES, "s"), (CUES, "c"), (SECRETS, "k"), (PREFIXES, "p")):
        for word in words:
            a.add_word(word, what)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def account(cue: str, text: str, at: int) -> tuple[int, int] | None:
    """The identifier that follows a cue: an IBAN by its check digits, others by their form.

    Dates are none. Without a mark in between (a colon, a number sign, "no", "number", "id") account and passport numbers need 8 digits, or 6 after a passport's letters.
    """
    said = SAID.match(text, at)
    start = said.end()
    if cue != "iban":
        m = FORMS[cue].match(text, start)
        if not m:
            return None
        plain = m[0].replace(" ", "").replace("-", "")
        bare = not said[1].strip() and plain[0].isdigit()
        return None if cue != "ssn" and (DATE.fullmatch(plain) or bare and len(plain) < 8) else (start, m.end())
    m = IBAN.match(text, start)
    stop = m.end() if m else 0
    while stop - start >= 15:
        if (stop == len(text) or not text[stop].isalnum()) and iban(text[start:stop]):
            return start, stop
        stop -= 1
        while text[stop - 1] in " -":
            stop -= 1
    return None


def iban(text: str) -> bool:
    """Whether the number made from an IBAN, its first four characters put last, leaves 1 when divided by 97."""
    t = text.replace(" ", "").replace("-", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def dotted(text: str, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """Spans of four numbers of at most 255 each within a run of digits and dots. Numbers are taken four by four, each once, so that a run takes linear time."""
    held: list[tuple[int, str]] = []
    for part in text[at:stop].split("."):
        held = [*held, (at, part)] if part else []
        at += len(part) + 1
        if len(held) == 4:
            if all(len(d := p.lstrip("0")) < 4 and int(d or "0") < 256 for _, p in held):
                yield held[0][0], 1, at - 1
            held = []


def secret(text: str, at: int) -> tuple[int, int, bool] | None:
    """(start, end, whether it is one) of the value that follows a cue: 16 characters or more, with a digit and eight different ones."""
    m = SECRET.match(text, at)
    if not m:
        return None
    good = len(set(m[1])) >= 8 and any(c in DIGITS for c in m[1])
    return m.start(1), m.start(1) + len(m[1].rstrip(".=")) if good else m.end(1), good


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every span of a text, code points, end exclusive, sorted."""
    out: list[tuple[int, int, int]] = []
    # ends of what each kind has consumed, dropped spans included
    email = ip = card = phone = url = told = hidden = failed = 0
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased; the cues are ASCII
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for end, what in anchors.iter(low):
        if what == "d":
            if end >= ip or end >= card:
                if end >= card:
                    m = CARD.match(text, end)
                    if m:
                        card = m.end()
                        number = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(number) <= 19 and luhn(number):
                            out.append((m.start(), 2, m.end()))
                    else:
                        card = end + 1
                if end >= ip:
                    stop = end
                    while stop < len(text) and text[stop] in DOTS:
                        stop += 1
                    ip = stop
                    out += dotted(text, end, stop)
        elif what == "@":
            start = end
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, end + 1) if start < end else None
            if m:
                email = m.end()
                out.append((start, 0, email))
        elif what == "+":
            if end >= phone and (m := PHONE.match(text, end)):
                phone = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((end, 3, phone))
        elif what == "s":
            start = next(end + 1 - len(s) for s in SCHEMES if low.endswith(s, 0, end + 1))
            if start >= url and (start == 0 or not text[start - 1].isalnum()) and (m := URL.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?'"))
                if stop > end + 1:
                    url = stop
                    out.append((start, 4, stop))
        elif what == "c" and end >= told:
            cue = next(c for c in CUES if low.endswith(c, 0, end + 1))
            start = end + 1 - len(cue)
            if (start == 0 or not text[start - 1].isalnum()) and (span := account(cue, text, end + 1)):
                told = span[1]
                out.append((span[0], 5, told))
        elif what == "k" and end >= max(hidden, failed):
            if span := secret(text, end + 1):
                if span[2]:
                    hidden = span[1]
                    out.append((span[0], 6, hidden))
                else:
                    failed = span[1]  # what ends a run that is no secret is none either
        elif what == "p":
            word = next(p for p in PREFIXES if low.endswith(p, 0, end + 1))
            start = end + 1 - len(word)
            if start >= hidden and (start == 0 or not text[start - 1].isalnum()) and (m := PREFIXES[word].match(text, start)):
                hidden = m.end()
                out.append((start, 6, hidden))
    out.sort()
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per input row.

    Base spans (email, ip, card, phone) are counted and digested; spans also lists urls, accounts and secrets. A null text counts as
    empty: no spans, the digest of nothing. Very long texts and runs of digits are read whole, in time that grows with their length. Null doc_ids and
    repeated rows are scanned like others; empty tables give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            counts, digests, spans = [], [], []
            for t in b.column(1):
                found = find(t.as_py() or "", anchors)
                base = [x for x in found if x[1] < BASE]
                counts.append([sum(x[1] == k for x in base) for k in range(BASE)])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(found))
            longs = [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)]
            yield pa.record_batch([b.column(0), *longs, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
