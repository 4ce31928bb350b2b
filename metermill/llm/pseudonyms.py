"""Format-preserving pseudonyms for personal numbers, dates and mail names.

A value is found by its form, validated (check digits, calendar, ranges), turned into an integer of its format's domain and sent
through a keyed Feistel permutation of that domain; cycle walking repeats it until the result is a valid value of
the same format.  So cards pass the check-digit test again, dates are dates, separators and letter case stay, and equal values
get equal pseudonyms in all documents, however they are punctuated.  With the key and ps_spans ``restored`` undoes it.

Where the longest text that fits a form fails its check, shorter heads that end between two groups are tried (an IBAN first at its
country's length, a card first as cards are printed), then the other kinds at that place, then later starts inside it.

Kinds: card (13-19 digits, Luhn), iban (mod 97), ssn, phone (+country code, or North American), ip (version 4),
date (year-month-day, also before the T of a timestamp, or day and month before a year; with - / or ., 1900-2099),
mail (the name before the @; the domain stays).

Defined results: a null text stays null; text without valid values stays as it is, byte for byte; repeated rows are treated
alike; an empty table gives an empty table; other columns pass through, but one that is
named ps_spans is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import prepare, without
from .text import slices

#: Setting of the session that holds the key where the caller gives none.
KEY_SETTING = "spark.metermill.pseudonymKey"
SPANS = "array<struct<kind:string,start:int,end:int>>"
ROUNDS = 8

_FORMS = {
    "mail": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"""(?<![\w./-])(?:\d{4}(?P<mark>[./-])\d{2}(?P=mark)\d{2}(?:(?=[Tt]\d)|(?![\w/-]|\.\d))
      | \d{1,2}(?P<sep>[./-])\d{1,2}(?P=sep)\d{4}(?![\w/-]|\.\d))""",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "phone": r"""(?<![\w+])(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d)
      | (?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\w-])""",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
}
FORMS = re.compile("|".join(f"(?P<{k}>{f})" for k, f in _FORMS.items()), re.VERBOSE | re.ASCII)
_EACH = {k: re.compile(f, re.VERBOSE | re.ASCII) for k, f in _FORMS.items()}
#: A place inside a span where one group of characters ends and another begins.
_BORDER = {"card": re.compile(r"(?<=\d)[ -](?=\d)"), "iban": re.compile(r"[ ]"), "phone": re.compile(r"(?<=[\d)])[ .-](?=[\d(])")}
_GROUP = re.compile(r"(?<=[ .(-])\d")
#: Cards as they are printed; tried before other cuts of a run of digits.
_PRINTED = re.compile(r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})(?![\w]|\.\d)", re.ASCII)
IBAN_LENGTH = {
    k: int(n)
    for n, ks in (
        x.split(":")
        for x in (
            "15:NO", "16:BE", "18:DK FK FO FI GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
            "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST",
            "26:IS TR", "27:BI DJ FR GR IT MC SM MR", "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE",
            "31:MT SC", "32:LC", "33:RU",
        )
    )
    for k in ks.split()
}
_HINT = re.compile(r"[0-9@]")
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1, walked until ``valid``."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.tweak = size, f"{kind}|{size}|".encode()
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask, self.key = (1 << self.half) - 1, hashlib.blake2b(key).digest()

    def _round(self, i: int, x: int) -> int:
        n = (self.half + 7) // 8
        out, block = b"", 0
        while len(out) < n:
            out += hashlib.blake2b(self.tweak + bytes([i, block]) + x.to_bytes(n, "big"), key=self.key).digest()
            block += 1
        return int.from_bytes(out[:n], "big") & self.mask

    def _forth(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for i in range(ROUNDS):
            a, b = b, a ^ self._round(i, b)
        return a << self.half | b

    def _back(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for i in reversed(range(ROUNDS)):
            a, b = b ^ self._round(i, a), a
        return a << self.half | b

    def walk(self, x: int, valid: Callable[[int], bool], undo: bool = False) -> int:
        step = self._back if undo else self._forth
        while True:
            x = step(x)
            if x < self.size and valid(x):
                return x


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _refill(form: str, digits: str) -> str:
    """The digits put where ``form`` has digits."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _is_card(digits: str) -> bool:
    return luhn(digits[:-1]) == int(digits[-1]) and digits[0] != "0"


def _printed(text: str, start: int, end: int) -> bool:
    m = _PRINTED.match(text, start)
    return m is not None and m.end() == end


def _card_inside(text: str, start: int, end: int) -> bool:
    """Does a valid card in a printed form start inside and not at the start?"""
    found = (_PRINTED.match(text, g.start()) for g in _GROUP.finditer(text, start + 1, end))
    return any(p is not None and _is_card(_digits(p.group())) for p in found)


def _ends(text: str, kind: str, span: re.Match) -> list[int]:
    """Where a value of ``kind`` may end: the form that its country or print gives it, the whole span, shorter heads."""
    start, end = span.span()
    if kind not in _BORDER:
        return [end]
    ends = [end, *reversed([b.start() for b in _BORDER[kind].finditer(text, start, end)])]
    if kind == "card":
        ends = [e for e in ends if len(_digits(text[start:e])) >= 13]
        first = [e for e in ends if _printed(text, start, e)]
    elif kind == "iban":
        length = IBAN_LENGTH.get(text[start : start + 2])
        first = [e for e in ends if len(text[start:e].replace(" ", "")) == length]
    else:
        first = []
    return [*first, *(e for e in ends if e not in first)]


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.key, self.cache = key, {}

    def _permute(self, kind: str, x: int, size: int, valid: Callable[[int], bool], undo: bool) -> int:
        known = (kind, size)
        if known not in self.cache:
            if len(self.cache) > 1000:
                self.cache.clear()
            self.cache[known] = Feistel(self.key, kind, size)
        return self.cache[known].walk(x, valid, undo)

    def card(self, s: str, undo: bool) -> str | None:
        d = _digits(s)
        if not _is_card(d):
            return None
        n = len(d) - 1
        # heads that are cards themselves stay such, and others do not become cards: the same value is found again
        heads = lambda body: [_is_card(body[:k]) for k in range(13, n + 1)]
        same = heads(d[:-1])
        body = f"{self._permute('card', int(d[:-1]), 10**n, lambda x: x >= 10 ** (n - 1) and heads(str(x)) == same, undo):0{n}d}"
        return _refill(s, body + str(luhn(body)))

    def iban(self, s: str, undo: bool) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = plain[4:]
        n = len(_digits(body))
        if not n:
            return None
        new = _refill(body, f"{self._permute('iban' + plain[:2], int(_digits(body)), 10**n, lambda x: True, undo):0{n}d}")
        full = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + new):02d}" + new)
        return "".join(c if c == " " else next(full) for c in s)

    def ssn(self, s: str, undo: bool) -> str | None:
        ok = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 and x % 10**4
        x = int(_digits(s))
        return _refill(s, f"{self._permute('ssn', x, 10**9, ok, undo):09d}") if ok(x) else None

    def phone(self, s: str, undo: bool) -> str | None:
        d = _digits(s)
        if len(d) == 10 + d.startswith("1") and (not s.startswith("+") or d[0] == "1") and len(d) in (10, 11):
            assignable = lambda x: x // 10**9 > 1 and x // 10**6 % 10 > 1
            x, head = int(d[-10:]), d[:-10]
            if not assignable(x) and not s.startswith("+"):
                return None
            # numbers that cannot be assigned (after +1 they still are meant as numbers) stay among themselves
            same = lambda y: assignable(y) == assignable(x)
            return _refill(s, head + f"{self._permute('phone1', x, 10**10, same, undo):010d}")
        if not s.startswith("+") or not 8 <= len(d) <= 15:
            return None
        code = re.match(r"\+(\d{1,3})", s)[1]
        n = len(d) - len(code)
        return _refill(s, code + f"{self._permute('phone' + code, int(d[len(code) :]), 10**n, lambda x: True, undo):0{n}d}")

    def ip(self, s: str, undo: bool) -> str | None:
        parts = [int(p) for p in s.split(".")]
        if max(parts) > 255 or any(str(p) != q for p, q in zip(parts, s.split("."), strict=True)) or not 1 <= parts[0] <= 223:
            return None
        x = int.from_bytes(bytes(parts), "big")
        return ".".join(map(str, self._permute("ip", x, 1 << 32, lambda y: 1 <= y >> 24 <= 223, undo).to_bytes(4, "big")))

    def date(self, s: str, undo: bool) -> str | None:
        p = re.split(r"[./-]", s)
        year_first = len(p[0]) == 4
        y, a, b = (int(x) for x in (p if year_first else (p[2], p[0], p[1])))
        month_first = year_first or s[len(p[0])] == "/" and a <= 12  # with slashes the month comes first where it can
        try:
            day = datetime.date(y, a, b) if month_first else datetime.date(y, b, a)
        except ValueError:
            return None
        x = day.toordinal() - _DAY0
        if not 0 <= x < _DAYS:
            return None
        # unpadded forms and slashes with both readings keep to dates that are read the same way
        wide = [len(q) == 2 for q in (p[1:] if year_first else p[:2])]

        def parts(x: int) -> list[int]:
            d = datetime.date.fromordinal(_DAY0 + x)
            return [d.month, d.day] if month_first else [d.day, d.month]

        ambiguous = not year_first and s[len(p[0])] == "/"

        def ok(x: int) -> bool:
            q = parts(x)
            return all(v <= 9 or w for v, w in zip(q, wide, strict=True)) and (not ambiguous or month_first or q[0] > 12)

        if not ok(x):
            return None
        kind = f"date{int(year_first)}{int(month_first)}{wide[0]:d}{wide[1]:d}{int(ambiguous)}" if ambiguous or not all(wide) else "date"
        x = self._permute(kind, x, _DAYS, ok, undo)
        q = [f"{v:02d}" if w else str(v) for v, w in zip(parts(x), wide, strict=True)]
        y = str(datetime.date.fromordinal(_DAY0 + x).year)
        return s[len(p[0])].join([y, *q] if year_first else [*q, y])

    def mail(self, s: str, undo: bool) -> str | None:
        name, domain = s.split("@")
        x, size = 0, 1
        for c in name.lower():
            radix, value = (26, ord(c) - 97) if "a" <= c <= "z" else (10, int(c)) if c in "0123456789" else (1, 0)
            x, size = x * radix + value, size * radix
        if size < 2:
            return None
        shape = "".join("a" if "a" <= c <= "z" else "0" if c in "0123456789" else c for c in name.lower())
        x = self._permute("mail" + shape + domain.lower(), x, size, lambda y: True, undo)
        out = []
        for c, kind in zip(reversed(name), reversed(shape), strict=True):
            if kind in "a0":
                x, v = divmod(x, 26 if kind == "a" else 10)
                c = str(v) if kind == "0" else chr(65 + v) if c.isupper() else chr(97 + v)
            out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def _at(self, text: str, m: re.Match, undo: bool) -> tuple[str, int, str | None]:
        """Kind, end and new form of the first valid value that starts where ``m`` does; form None if there is none."""
        kinds = list(_EACH)
        for kind in kinds[next(i for i, k in enumerate(kinds) if m[k] is not None) :]:
            if not (span := _EACH[kind].match(text, m.start())):
                continue
            for end in _ends(text, kind, span):
                cut = kind == "phone" and end < span.end() or kind == "card" and not _printed(text, m.start(), end)
                if cut and _card_inside(text, m.start(), end):
                    continue
                if (new := getattr(self, kind)(text[m.start() : end], undo)) is not None:
                    return kind, end, new
        return "", m.end(), None

    def back(self, text: str, spans: list[tuple[str, int, int]]) -> str:
        """The text before pseudonyms were put at ``spans``: no form has to be found again."""
        out, at = [], 0
        for kind, a, b in spans:
            old = getattr(self, kind)(text[a:b], True)
            out += [text[at:a], text[a:b] if old is None else old]
            at = b
        return "".join([*out, text[at:]])

    def text(self, text: str, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, start and end (code points of the new text) of each."""
        if not _HINT.search(text):
            return text, []
        out, spans, at, size = [], [], 0, 0
        look = 0
        while m := FORMS.search(text, look):
            kind, end, new = self._at(text, m, undo)
            if new is None:
                look = m.end() if m["mail"] else m.start() + 1  # what is valid may start inside
                continue
            size += m.start() - at
            out += [text[at : m.start()], new]
            spans.append((kind, size, size + len(new)))
            at, size = end, size + len(new)
            look = at
        return "".join([*out, text[at:]]), spans


def secret(spark: SparkSession, key: bytes | None) -> bytes:
    """The caller's key or the session's; there is no default, as whoever has the key can undo the pseudonyms."""
    if key is None:
        key = spark.conf.get(KEY_SETTING, "").encode()
    if not key:
        raise ValueError(f"pseudonyms need a key: pass one or set {KEY_SETTING}")
    return key


def pseudonymized(docs: DataFrame, text_col: str = "text", key: bytes | None = None, undo: bool = False) -> DataFrame:
    """``docs`` with the text rewritten and ps_spans, an array of (kind, start, end).

    A new key is a new pseudonym for everything: to change keys, ``restored`` with the old one and run again with the new one.
    """
    key = secret(docs.sparkSession, key)
    prepare(docs.sparkSession)
    empty = F.lit(None).cast(SPANS).alias("ps_spans")
    known = undo and dict(docs.dtypes).get("ps_spans") == SPANS
    plain = without(docs, {"ps_spans"})
    schema = plain.select("*", empty).schema
    docs = plain.select("*", empty) if not known else docs.select(*[F.col(f"`{c}`") for c in plain.columns], "ps_spans")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Pseudonymizer(key)
        for batch in batches:
            for part in slices(batch, text_col):
                texts, spans = [], []
                for t, old in zip(part.column(text_col).to_pylist(), part.column("ps_spans").to_pylist(), strict=True):
                    if t is not None and old is not None:
                        new, found = machine.back(t, [(s["kind"], s["start"], s["end"]) for s in old]), []
                    else:
                        new, found = (None, []) if t is None else machine.text(t, undo)
                    texts.append(new)
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                cols = part.columns[:-1]
                cols[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, span)], names=part.schema.names)

    return docs.mapInArrow(run, schema)


def restored(docs: DataFrame, text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """The texts as they were before ``pseudonymized`` with the same key.  Exact with its ps_spans; without that column the values
    are found again by form, which can fail where other digits stand next to one."""
    return pseudonymized(docs, text_col, key, undo=True).drop("ps_spans")
