"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

Every value that passes its kind's validation is replaced within its own format by a keyed Feistel network, so equal
values have equal pseudonyms in all documents, different values of a kind differ, and the key holder can turn them
back. Digits stay digits, letters stay letters of the same case, and separators stay. A network whose permuted domain
isn't the kind's (all dates, all numbers with a right check digit) walks its cycle until it comes back into it.

Kinds: email (its local part, and the host's first label), phone (with a prefix, brackets or a national pattern), card
(an issuer's prefix and length, and Luhn), iban (mod 97), ssn, ipv4, ipv6, mac, date (a real calendar date in numbers,
1900 to 2099), secret (access keys, tokens, passwords and the like). Bare runs of digits and dates in words are none.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import only, sparing

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. size - 1: a balanced network over a square that holds it, walked into it."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.half = size, 1
        while self.half * self.half < size:
            self.half *= 2
        self.keys = [hmac.new(key, f"{kind}|{size}|{r}".encode(), hashlib.sha256).digest() for r in range(ROUNDS)]

    def _round(self, r: int, x: int) -> int:
        width = max(8, (self.half.bit_length() + 7) // 8 + 8)
        return int.from_bytes(hashlib.blake2b(x.to_bytes(width, "big"), key=self.keys[r], digest_size=min(64, width)).digest(), "big")

    def forward(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.half)
            for r in range(ROUNDS):
                a, b = b, (a + self._round(r, b)) % self.half
            x = a * self.half + b
            if x < self.size:
                return x

    def back(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.half)
            for r in reversed(range(ROUNDS)):
                a, b = (b - self._round(r, a)) % self.half, a
            x = a * self.half + b
            if x < self.size:
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


# First digits and lengths of the numbers that card issuers give out.
ISSUERS = re.compile(
    r"""4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})                                                      # Visa
    |(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}        # Mastercard
    |3[47][0-9]{13}                                                                           # American Express
    |3(?:0[0-5]|[689][0-9])[0-9]{11,16}                                                       # Diners Club
    |(?:6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12,15}                                             # Discover
    |62[0-9]{14,17}                                                                           # UnionPay
    |35(?:2[89]|[3-8][0-9])[0-9]{12,15}                                                       # JCB
    |(?:50|5[6-9]|6[0379])[0-9]{10,17}                                                        # Maestro""",
    re.VERBOSE,
)


def card_ok(digits: str) -> bool:
    return ISSUERS.fullmatch(digits) is not None and luhn(digits)


def iban_ok(text: str) -> bool:
    s = re.sub(r"[ -]", "", text).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
HEXADECIMAL = re.compile(r"(?=[0-9]*[a-f])[0-9a-f]+|(?=[0-9]*[A-F])[0-9A-F]+")
DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Pseudonyms:
    """Replaces values of a kind. Keeps the networks and, up to a bound, the values replaced."""

    def __init__(self, key: bytes):
        self.key, self.nets, self.known = key, {}, {}

    def net(self, kind: str, size: int) -> Feistel:
        if (kind, size) not in self.nets:
            if len(self.nets) > 4096:
                self.nets.clear()
            self.nets[kind, size] = Feistel(self.key, kind, size)
        return self.nets[kind, size]

    def permute(self, kind: str, text: str, back: bool = False) -> str:
        """Every ASCII digit and letter stays of its class; all of them together are one permuted number."""
        where, number, size = [], 0, 1
        for i, c in enumerate(text):
            for letters in (DIGIT, LOWER, UPPER):
                if c in letters:
                    where.append((i, letters))
                    number, size = number * len(letters) + letters.index(c), size * len(letters)
        if not where:
            return text
        shape = "".join("dlu"[(DIGIT, LOWER, UPPER).index(letters)] for _, letters in where)
        net = self.net(f"{kind}|{shape}", size)
        number = net.back(number) if back else net.forward(number)
        out = list(text)
        for i, letters in reversed(where):
            number, k = divmod(number, len(letters))
            out[i] = letters[k]
        return "".join(out)

    def _walk(self, kind: str, text: str, valid: Callable[[str], bool], back: bool) -> str:
        """Permutes until valid again; the cycle holds text itself, so this ends."""
        while True:
            text = self.permute(kind, text, back)
            if valid(text):
                return text

    def _digits(self, text: str, new: str) -> str:
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def replace(self, kind: str, text: str, back: bool = False) -> str:
        key = (kind, text, back)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._replace(kind, text, back)
        return self.known[key]

    def _replace(self, kind: str, text: str, back: bool) -> str:
        if kind in ("card", "phone", "ssn"):
            # equal numbers have equal pseudonyms however they are written
            digits = "".join(c for c in text if c in DIGIT)
            if kind == "card":
                new = self._walk(kind, digits, card_ok, back)
            elif kind == "ssn":
                new = self._walk(kind, digits, lambda s: ssn_ok(s), back)
            else:
                keep = min(3, len(digits) - 7) if text.startswith(("+", "00")) else 0
                head = digits[: max(0, keep)]
                new = head + self.permute(f"phone{len(head)}", digits[len(head) :], back)
            return self._digits(text, new)
        if kind == "iban":
            flat = re.sub(r"[ -]", "", text)
            body = self.permute(f"iban|{flat[:2].upper()}", flat[4:], back)
            check = 98 - int("".join(str(int(c, 36)) for c in (body + flat[:2]).upper()) + "00") % 97
            it = iter(f"{flat[:2]}{check:02d}{body}")
            return "".join(c if c in " -" else next(it) for c in text)
        if kind == "ipv4":
            parts = [int(p) for p in text.split(".")]
            n = self.net(kind, 1 << 32)
            v = int.from_bytes(bytes(parts), "big")
            return ".".join(map(str, (n.back(v) if back else n.forward(v)).to_bytes(4, "big")))
        if kind in ("ipv6", "mac"):
            groups = [g.zfill(4) if kind == "ipv6" else g for g in re.split("[:-]", text)]
            new, width = self._hex(kind, "".join(groups), back), len(groups[0])
            it = iter(new[i : i + width] for i in range(0, len(new), width))
            return re.sub(r"[0-9A-Fa-f]+", lambda m: next(it), text)
        if kind == "date":
            return self._date(text, back)
        if kind == "email":
            local, _, host = text.rpartition("@")
            label, dot, rest = host.partition(".")
            return f"{self.permute('local', local, back)}@{self.permute('host', label, back)}{dot}{rest}"
        if kind == "secret":
            m = SECRET_VALUE.match(text)
            # hexadecimal values with a letter are a class of their own; neither class runs into the other
            if not HEXADECIMAL.fullmatch(m[2]):
                return m[1] + self._walk(kind, m[2], lambda s: not HEXADECIMAL.fullmatch(s), back) + m[3]
            value = self._hex(kind, m[2].lower(), back)
            while not HEXADECIMAL.fullmatch(value):
                value = self._hex(kind, value, back)
            return m[1] + (value.upper() if m[2].isupper() else value) + m[3]
        raise ValueError(kind)

    def _hex(self, kind: str, text: str, back: bool) -> str:
        net = self.net(f"{kind}{len(text)}", 16 ** len(text))
        out = f"{(net.back if back else net.forward)(int(text, 16)):0{len(text)}x}"
        return out.upper() if re.search("[A-F]", text) else out

    def _date(self, text: str, back: bool) -> str:
        found = parse_date(text)
        day, order, parts = found
        net = self.net("date", DAYS)
        n = (day - FIRST_DAY).days
        new = FIRST_DAY + datetime.timedelta(net.back(n) if back else net.forward(n))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return f"{values[order[0]]}{parts[1]}{values[order[1]]}{parts[3]}{values[order[2]]}"


def parse_date(text: str):
    """(date, order of y m d, parts) of 2021-03-04, 2021/03/04, 2021.03.04, 04.03.2021, 04/03/2021 or 04-03-2021.
    With the year last, the day comes first unless only the other reading is a date."""
    parts = re.split(r"([-/.])", text)
    if len(parts) != 5 or parts[1] != parts[3]:
        return None
    for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        v = {k: int(p) for k, p in zip(order, parts[::2], strict=True)}
        try:
            day = datetime.date(v["y"], v["m"], v["d"])
        except ValueError:
            continue
        if FIRST_DAY <= day < FIRST_DAY + datetime.timedelta(DAYS):
            return day, order, parts
    return None


def ssn_ok(text: str) -> bool:
    d = "".join(c for c in text if c in DIGIT)
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


# Without a prefix or brackets: three, three and four digits, or a trunk 0 and groups, with one kind of separator.
NATIONAL = re.compile(r"(?:1[ .-])?[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4}|0[1-9][0-9]{0,3}([ .-])[0-9]{2,4}(?:\2[0-9]{2,4}){1,3}")


def phone_ok(text: str) -> bool:
    """With a plus, an international 00 or brackets 7 to 15 digits count; else only a national pattern does."""
    digits = sum(c in DIGIT for c in text)
    if text.startswith("+") or "(" in text:
        return 7 <= digits <= 15
    if text.startswith("00"):
        return 10 <= digits <= 15 and text[2] in "123456789" and any(c in " .-" for c in text)
    return 9 <= digits <= 11 and NATIONAL.fullmatch(text) is not None


# Edges: no letter, digit or mark of the same value may go on at either side.
_DETECT = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w@]))
    |(?P<secret>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b
        |\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bsk-[A-Za-z0-9_-]{20,}
        |"[0-9a-fA-F]{32,64}"|(?<![\w])[0-9a-fA-F]{40}(?![\w]))
    |(?P<signed>\beyJ)
    |(?P<keyed>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b["']?[ ]?[=:][ ]?["']?))
    |(?P<iban>(?<![\w])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w]))
    |(?P<mac>(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-]))
    |(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:]))
    |(?P<date>(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\6[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\7[0-9]{4})(?![\w/-]|\.[0-9]))
    |(?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![\w]))
    |(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}|(?:(?:\+|00)?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4})(?![\w]))""".replace("\\6", "(?P=ds)").replace("\\7", "(?P=de)").replace("{4}([-/.])", "{4}(?P<ds>[-/.])").replace("[0-9]{1,2}([-/.])", "[0-9]{1,2}(?P<de>[-/.])"),
    re.VERBOSE,
)
SECRET_VALUE = re.compile(r"""((?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?[ ]?[=:][ ]?["']?)|"|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|)(.*?)("?)\Z""", re.DOTALL)

VALID: dict[str, Callable[[str], object]] = {
    "email": lambda s: ".." not in s,
    "secret": lambda s: True,
    "iban": iban_ok,
    "mac": lambda s: True,
    "ipv6": lambda s: True,
    "date": parse_date,
    "ipv4": lambda s: all(int(p) < 256 and (p == "0" or p[0] != "0") for p in s.split(".")),
    "ssn": ssn_ok,
    "card": lambda s: card_ok("".join(c for c in s if c in DIGIT)) and len(set(s) & set(DIGIT)) > 1,
    "phone": phone_ok,
}
KINDS = list(VALID)
_GROUPS = (*KINDS, "keyed", "signed")


class _Runs:
    """Ends of runs of a pattern's characters in a text. The last run is kept, so that a text full of places that ask
    for the end of one long run is read once."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text, self.pattern, self.begin, self.stop = text, pattern, 0, -1

    def end(self, at: int) -> int:
        if not self.begin <= at < self.stop:
            m = self.pattern.match(self.text, at)
            self.begin, self.stop = at, m.end()
        return max(at, self.stop)


_VALUE, _WIDE, _TOKEN = (re.compile(c) for c in (r"""[^\s"',;]*""", r"""[^\s"']*""", r"[A-Za-z0-9_-]*"))
_NUMBER = re.compile(r"[0-9]|\Z")


class _Secrets:
    """Ends of values of any length: what follows a keyword, and signed tokens of three parts."""

    def __init__(self, text: str):
        self.text, self.value, self.wide = text, _Runs(text, _VALUE), _Runs(text, _WIDE)
        self.parts = [_Runs(text, _TOKEN) for _ in range(3)]
        self.digit = -1

    def keyed(self, at: int) -> int | None:
        """The end of a value of six characters or more from at on, with a digit before white space or a quote."""
        end = self.value.end(at)
        if end - at < 6:
            return None
        if self.digit < at:
            self.digit = _NUMBER.search(self.text, at).start()
        return end if self.digit < self.wide.end(at) else None

    def signed(self, at: int) -> int | None:
        at += 3
        for k, (runs, least) in enumerate(zip(self.parts, (8, 8, 4), strict=True)):
            end = runs.end(at)
            if end - at < least or k < 2 and self.text[end : end + 1] != ".":
                return None
            at = end + 1
        return end


def find(text: str):
    """(kind, start, end) of every valid value, from left to right. What fails its kind's test may yet be another
    kind that begins at the same place or after it. The time is in proportion to the text."""
    at, secrets = 0, _Secrets(text)
    while m := _DETECT.search(text, at):
        kind = m.lastgroup if m.lastgroup in _GROUPS else next(k for k in _GROUPS if m[k] is not None)
        s, e = m.span(kind)
        if kind in ("keyed", "signed"):
            e = secrets.keyed(e) if kind == "keyed" else secrets.signed(s)
            kind = "secret"
        if kind in ("card", "phone") and (other := _NEXT.search(text, s, e + 48)) and s < other.start() < e:
            e = other.start()  # an address or a long number begins there
        if e is not None and VALID[kind](text[s:e]):
            yield kind, s, e
            at = e
        elif kind in ("card", "date", "ipv4", "ssn", "iban") and (p := _PHONE.match(text, s)) and phone_ok(p[0]):
            yield "phone", s, p.end()
            at = p.end()
        elif kind in ("phone", "card") and (p := _LOCAL.match(text, s)):
            yield "phone", s, p.end()
            at = p.end()
        else:
            at = m.end() if kind == "secret" else _STEP.match(text, s).end() if _STEP.match(text, s) else s + 1


_NEXT = re.compile(r" (?=(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w])|[0-9]{13,19}(?![\w]))")
_PHONE = re.compile(r"(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}|(?:(?:\+|00)?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4})(?![\w])")
_LOCAL = re.compile(rf"(?:{NATIONAL.pattern})(?![\w])")
_STEP = re.compile(r"[\w+(]+")
# What every branch of _DETECT needs, in RE2's syntax: a text without any of it holds no value. Kinds that can do without
# a digit and an @ are keys with a prefix, and hexadecimal values and addresses of letters alone.
INTEREST = r"""[0-9@]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|"[a-fA-F]{32}|[a-fA-F]{40}|[a-fA-F]{2}(?:[:-][a-fA-F]{2}){5}|(?:[a-fA-F]{1,4}:){7}[a-fA-F]"""


def pseudonymised(text: str, names: Pseudonyms) -> tuple[str, dict[str, int]]:
    out, at, counts = [], 0, {}
    for kind, s, e in find(text):
        out += [text[at:s], names.replace(kind, text[s:e])]
        at = e
        counts[kind] = counts.get(kind, 0) + 1
    return ("".join([*out, text[at:]]) if out else text), counts


def _apply(key: bytes, place: int):
    def apply(batches):
        names = Pseudonyms(key)
        for batch in batches:
            column = batch.column(place)
            texts = column.to_pylist()
            # a cheap test first, which leaves out only texts without any value
            look = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, INTEREST), False).to_numpy(zero_copy_only=False))
            counts: list = [[0] * len(texts) for _ in KINDS]
            for i in look.tolist():
                texts[i], found = pseudonymised(texts[i], names)
                for kind, n in found.items():
                    counts[KINDS.index(kind)][i] = n
            cols = [c if i != place else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int64()) for c in counts)], [f"c{i}" for i in range(len(cols) + len(KINDS))])

    return apply


def with_pseudonyms(docs: DataFrame, key: bytes, column: str = "text", counts: bool = True) -> DataFrame:
    """docs with every validated personal value in a string column replaced, and n_<kind> long counts after its
    columns (n_<kind> columns of docs give way to these; counts=False leaves the counts out).

    Null and empty texts stay as they are, with counts of 0. All rows and other columns are kept, repeated rows alike.
    Equal values get equal pseudonyms in all rows, partitions and runs with the same key.
    """
    added = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if not counts or c not in added]
    plain = docs.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") if c == column else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + [f"c{len(kept) + i} long" for i in range(len(KINDS))])
    out = plain.mapInArrow(sparing(_apply(key, kept.index(column))), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept + (added if counts else []))])


def private_values(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the pseudonymised text, how many values of each kind were replaced, and all of them (n_values)."""
    out = with_pseudonyms(only(docs, "doc_id", "text"), key)
    return out.withColumn("n_values", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")))
