"""Personal data: patterns propose spans, checksums confirm them, nearby words move their scores."""

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import whole_text

# Kinds that are reported whatever their score, in the order of reports; then those that need a score.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.5
CONTEXT_CHARS = 48
RAISED, LOWERED = 0.35, 0.35
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_REVERSED = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Countries by the registered length of their account numbers; those of other countries have any length.
_IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBAN_LENGTH = {country: n for n, countries in _IBAN_LENGTHS.items() for country in countries.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = sum(int(d) for d in digits[::-2]) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's check digits leave 1 modulo 97."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping addresses.

    Each ``@`` with a domain is extended to the left, no further than the end of the address before it. That gives
    the matches of the one-pass pattern without its quadratic time on long words.
    """
    found, floor = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        width = 64
        while True:
            low = max(floor, at - width)
            run = _LOCAL_REVERSED.match(text[low:at][::-1])
            size = run.end() if run else 0
            if size < at - low or low == floor:
                break
            width *= 4
        if size:
            floor = m.end()
            found.append((at - size, floor))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            found.append(m.span())
    return found


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers that the check confirms, cut at the end of a word: words around a number may look like parts of it.

    Numbers of a listed country have its length. Those of others have the greatest that is confirmed, and do not overlap
    the listed ones.
    """
    found, loose, at = [], [], 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 4
        ends = [e for e in range(m.end(), start + 14, -1) if not (text[e : e + 1].isascii() and text[e : e + 1].isalnum())]
        length = _IBAN_LENGTH.get(m.group()[:2])
        for end in ends:
            code = text[start:end].replace(" ", "")
            if len(code) == (length or max(len(code), 15)) and mod97(code):
                if length:
                    found.append((start, end))
                    at = end
                else:
                    loose.append((start, end))
                break
    if loose:
        end = 0
        for s, e in loose:
            if s >= end and not any(a < e and s < b for a, b in found):
                found.append((s, e))
                end = e
        found.sort()
    return found


def ssns(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            found.append(m.span())
    return found


def local_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _LOCAL_PHONE.finditer(text)]


@dataclass(frozen=True)
class Recognizer:
    """Proposes confirmed spans of one kind; words nearby raise or lower their score."""

    kind: str
    find: Callable[[str], list[tuple[int, int]]]
    score: float
    near: tuple[str, ...] = ()
    against: tuple[str, ...] = ()
    #: a text without any of these characters holds no span
    needs: str = "0123456789"
    words: re.Pattern | None = field(init=False, default=None)
    bad: re.Pattern | None = field(init=False, default=None)

    def __post_init__(self):
        for name, words in (("words", self.near), ("bad", self.against)):
            if words:
                pattern = r"(?<![a-z])(?:" + "|".join(map(re.escape, words)) + r")(?![a-z])"
                object.__setattr__(self, name, re.compile(pattern, re.IGNORECASE))


RECOGNIZERS = (
    Recognizer("email", emails, 0.9, ("email", "e-mail", "mail", "contact"), (), "@"),
    Recognizer("ip", ips, 0.6, ("ip", "address", "server", "host"), ("version", "release", "section")),
    Recognizer("card", cards, 0.7, ("card", "visa", "mastercard", "credit", "debit", "payment"), ("isbn", "tracking")),
    Recognizer("phone", phones, 0.7, ("phone", "call", "tel", "telephone", "mobile", "fax"), (), "+"),
    Recognizer("iban", ibans, 0.8, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Recognizer("ssn", ssns, 0.3, ("ssn", "social security", "social"), ("order", "part", "invoice"), "-"),
    Recognizer("local_phone", local_phones, 0.3, ("phone", "call", "tel", "telephone", "mobile", "fax", "cell")),
)


def spans_in(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Scored spans, by kind as listed, then start.

    The base kinds are all kept. The others are kept from ``threshold`` on, if no base span overlaps them.
    """
    found, taken = [], []
    for r in RECOGNIZERS:
        if not any(c in text for c in r.needs):
            continue
        base = r.kind in BASE_KINDS
        for start, end in r.find(text):
            score = r.score
            before = text[max(0, start - CONTEXT_CHARS) : start]
            after = text[end : end + CONTEXT_CHARS]
            if r.words and (r.words.search(before) or r.words.search(after)):
                score = min(1.0, score + RAISED)
            if r.bad and (r.bad.search(before) or r.bad.search(after)):
                score = max(0.0, score - LOWERED)
            if base:
                taken.append((start, end))
            elif score < threshold or any(s < end and start < e for s, e in taken):
                continue
            found.append((r.kind, start, end, round(score, 4)))
    return found


def redacted_text(text: str, threshold: float = THRESHOLD) -> str:
    """The text with each maximal run of overlapping spans replaced by the name of its first span's kind."""
    spans = sorted((s, e, k) for k, s, e, _ in spans_in(text, threshold))
    if not spans:
        return text
    parts, end = [], 0
    for s, e, kind in spans:
        if s >= end:
            parts += [text[end:s], f"<{kind.upper()}>"]
        end = max(end, e)
    return "".join([*parts, text[end:]])


def spans_column(text: str | Column = "text", threshold: float = THRESHOLD) -> Column:
    """The spans of a text column as ``array<struct<kind, start, end, score>>``; offsets count code points."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                [dict(zip(("kind", "start", "end", "score"), s)) for s in spans_in(t.as_py() or "", threshold)]
                for t in texts
            ],
            kind,
        )

    return spans(text)


def redacted_column(text: str | Column = "text", threshold: float = THRESHOLD) -> Column:
    """The text column without personal data; null stays null."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        found = (t.as_py() for t in texts)
        return pa.array([None if t is None else redacted_text(t, threshold) for t in found], pa.string())

    return redacted(text)


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``pii``, the scored spans of each whole text, one row per row of ``docs``.

    A null or empty text has an empty list. Other columns are not carried, so clashing names do no harm; repeated rows
    and null ids pass through. No shuffle: texts meet the patterns where they are read.
    """
    return docs.select("doc_id", spans_column(whole_text(), threshold).alias("pii"))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with personal data replaced in ``text``; ``n_chars``, if there, is counted anew."""
    out = docs.withColumn("text", redacted_column("text", threshold))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
