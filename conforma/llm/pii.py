"""Format-preserving pseudonyms for personal data and secrets.

Each value that passes its kind's validation (check digits, calendar, octets, number plans) becomes a
number inside its format's domain, a keyed Feistel network permutes that domain, and the result is
written in the same format, valid again. The permutation depends on the key and the format alone, so
equal values stay equal in every document, and different ones different.

Defined cases: a null text stays null with zero counts; text without values stays as it is; repeated
documents each give a row; all other columns pass through, except that columns named like the counts
are replaced; an empty table gives an empty result. Values are looked for inside lines, but for private-key blocks
and for secrets that stand alone on the line after their keyword. What a pseudonym would leave as it is (no
letter or digit) isn't counted.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "phone", "card", "ip", "date", "iban", "ssn", "secret")
KEY = b"replace this key in production"
ROUNDS = 8
LONG = 128


class Feistel:
    """A keyed permutation of range(n) for any n: alternating Feistel rounds over a times b >= n,
    walked along its cycle until it is inside again."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, value: int) -> int:
        said = f"{tweak}/{i}/{value}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=64).digest(), "big")

    def permute(self, value: int, n: int, tweak: str) -> int:
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(tweak, i, left)) % b
                else:
                    left = (left + self._round(tweak, i, right)) % a
            value = left * b + right
            if value < n:
                return value

    def restore(self, value: int, n: int, tweak: str) -> int:
        """The inverse of permute()."""
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - self._round(tweak, i, left)) % b
                else:
                    left = (left - self._round(tweak, i, right)) % a
            value = left * b + right
            if value < n:
                return value


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS_OF = {c: x for x in _CLASSES for c in x}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_BASE36 = {c: _CLASSES[0] + _CLASSES[2] for c in _CLASSES[0] + _CLASSES[2]}


def luhn(payload: str) -> str:
    """The check digit of a payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    digits = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{98 - int(digits) % 97:02d}"


class Pseudonyms:
    def __init__(self, key: bytes = KEY):
        self.feistel = Feistel(key)

    def string(self, text: str, tweak: str, classes: dict[str, str] = _CLASS_OF) -> str:
        """Permutes the letters and digits together, each inside its class."""
        if len(text) > LONG:
            return self._long(text, tweak, classes)
        value, n = 0, 1
        for c in text:
            if x := classes.get(c):
                value, n = value * len(x) + x.index(c), n * len(x)
        shape = "".join(classes[c][0] if c in classes else c for c in text)
        value = self.feistel.permute(value, n, f"{tweak}/{shape}")
        out = []
        for c in reversed(text):
            if x := classes.get(c):
                value, at = divmod(value, len(x))
                c = x[at]
            out.append(c)
        return "".join(reversed(out))

    def _long(self, text: str, tweak: str, classes: dict[str, str]) -> str:
        """string() of many characters: in a round, one half's characters each move inside their class by
        an XOF's numbers of the other half, so that time grows with the length alone."""
        sets = [classes[c] for c in text if c in classes]
        sizes = np.array([len(x) for x in sets], np.uint64)
        at = np.array([x.index(c) for x, c in zip(sets, (c for c in text if c in classes), strict=True)], np.uint64)
        shape = "".join(classes[c][0] if c in classes else c for c in text)
        half = len(at) // 2
        parts, of = [at[:half], at[half:]], [sizes[:half], sizes[half:]]
        for i in range(ROUNDS):
            a, b = parts[i % 2], parts[1 - i % 2]
            said = self.feistel.key + f"{tweak}/{shape}/{i}/".encode() + b.astype(np.uint8).tobytes()
            moves = np.frombuffer(hashlib.shake_256(said).digest(8 * len(a)), "<u8")
            parts[i % 2] = (a + moves % of[i % 2]) % of[i % 2]
        new = iter(np.concatenate(parts).tolist())
        return "".join(classes[c][next(new)] if c in classes else c for c in text)

    def _refill(self, text: str, digits: str) -> str:
        """Puts other digits into the places of a text's digits."""
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in text)

    def email(self, m: re.Match) -> str | None:
        local, _, domain = m[0].rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{self.string(local, 'local')}@{self.string(name, 'domain')}.{top}"

    def phone(self, m: re.Match) -> str | None:
        digits = "".join(c for c in m[0] if c.isdigit())
        if not 8 <= len(digits) <= 15:
            return None
        national = digits[-10:] if len(digits) in (10, 11) and digits[:-10] in ("", "1") else ""
        if national and national[0] > "1" and national[3] > "1":
            area, exchange, line = int(national[:3]) - 200, int(national[3:6]) - 200, int(national[6:])
            v = self.feistel.permute((area * 800 + exchange) * 10000 + line, 64 * 10**8, "phone")
            v, line = divmod(v, 10000)
            area, exchange = divmod(v, 800)
            new = f"{digits[:-10]}{area + 200}{exchange + 200}{line:04d}"
        else:  # the first three digits hold the country
            n = len(digits) - 3
            new = digits[:3] + f"{self.feistel.permute(int(digits[3:]), 10**n, f'phone{n}'):0{n}d}"
        return self._refill(m[0], new)

    def card(self, m: re.Match) -> str | None:
        digits = "".join(c for c in m[0] if c.isdigit())
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != digits[-1]:
            return None
        n = len(digits) - 2
        new = digits[0] + f"{self.feistel.permute(int(digits[1:-1]), 10**n, f'card{n}'):0{n}d}"
        return self._refill(m[0], new + luhn(new))

    def ip(self, m: re.Match) -> str | None:
        octets = [int(x) for x in m[0].split(".")]
        if max(octets) > 255:
            return None
        v = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
        return ".".join(map(str, v.to_bytes(4, "big")))

    def date(self, m: re.Match) -> str | None:
        a, sep, b, _, c = m.group("d1", "sep", "d2", "sep", "d3")
        year_first = len(a) == 4
        if year_first == (len(c) == 4):
            return None
        year, day = (int(a), int(c)) if year_first else (int(c), int(a))
        month = int(b)
        swapped = not year_first and month > 12 >= day
        if swapped:
            month, day = day, month
        try:
            value = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        first = datetime.date(year // 100 * 100 or 1, 1, 1).toordinal()
        last = datetime.date(year // 100 * 100 + 99, 12, 31).toordinal()
        new = first + self.feistel.permute(value - first, last - first + 1, f"date{year // 100}")
        d = datetime.date.fromordinal(new)
        if year_first:
            return f"{d.year:04d}{sep}{d.month:0{len(b)}d}{sep}{d.day:0{len(c)}d}"
        x, y = (d.month, d.day) if swapped else (d.day, d.month)
        return f"{x:0{len(a)}d}{sep}{y:0{len(b)}d}{sep}{d.year:04d}"

    def iban(self, m: re.Match) -> str | None:
        packed = m[0].replace(" ", "")
        country, check, account = packed[:2], packed[2:4], packed[4:]
        if iban_check(country, account) != check:
            return None
        new = self.string(account, f"iban{country}")
        left = iter(country + iban_check(country, new) + new)
        return "".join(c if c == " " else next(left) for c in m[0])

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = (int(x) for x in m[0].split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        at = area - 1 - (area > 666)
        v = self.feistel.permute((at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        v, serial = divmod(v, 9999)
        at, group = divmod(v, 99)
        return f"{at + 1 + (at + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def secret(self, m: re.Match) -> str | None:
        if m["cloud"]:
            return m["cloud"][:4] + self.string(m["cloud"][4:], "cloud", _BASE36)
        if m["hex"]:
            return m[0][: -len(m["hex"])] + self.string(m["hex"], "hex", _HEX)
        if m["signed"]:
            return m[0][:3] + self.string(m[0][3:], "signed")
        start = m.start("value") - m.start()
        return m[0][:start] + self.value(m["value"])

    def value(self, value: str) -> str:
        """A secret named by a keyword."""
        hexa = all(c in _HEX for c in value)
        return self.string(value, "hex" if hexa else "value", _HEX if hexa else _CLASS_OF)

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its values replaced, and the number of each kind."""
        if not _TRIGGER.search(text):
            return text, {}
        counts: dict[str, int] = {}

        def one(m: re.Match) -> str:
            kind = m.lastgroup
            new = getattr(self, kind)(m)
            if new is None or new == m[0]:
                return m[0]
            counts[kind] = counts.get(kind, 0) + 1
            return new

        def alone(m: re.Match) -> str:
            new = self.value(m["value"])
            if new != m["value"]:
                counts["secret"] = counts.get("secret", 0) + 1
            return m[0][: m.start("value") - m.start()] + new + m[0][m.end("value") - m.start() :]

        def lines(part: str) -> str:
            rows, named = part.split("\n"), False
            for i, line in enumerate(rows):
                if named and _ALONE.fullmatch(line):
                    rows[i], named = _ALONE.sub(alone, line), False
                elif _TRIGGER.search(line):
                    rows[i], named = _VALUE.sub(one, line), bool(_NAMED.search(line))
                elif line.strip():
                    named = False
            return "\n".join(rows)

        out, at = [], 0
        for m in _BLOCK.finditer(text) if _BLOCK_HEAD in text else ():
            out += [lines(text[at : m.start("key")]), self.string(m["key"], "block")]
            counts["secret"] = counts.get("secret", 0) + 1
            at = m.end("key")
        return "".join([*out, lines(text[at:])]), counts


_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_BLOCK_HEAD = "-----BEGIN "
_KEYWORD = r"(?i:password|passwd|pwd|secret|api[_\-]?key|token)"
#: A line without these has no value of any kind: all that _VALUE matches has a digit, an at sign, a
#: keyword, a cloud key's or signed token's head or 32 letters that are hexadecimal digits.
_TRIGGER = re.compile(rf"[0-9@]|AKIA|eyJ|[a-f]{{32}}|{_KEYWORD}|{_BLOCK_HEAD}")
#: A keyword that ends its line, and a value that fills one.
_NAMED = re.compile(rf"{_EDGE}{_KEYWORD}\s{{0,4}}[=:]\s*$")
_ALONE = re.compile(r"\s*[\"']?(?P<value>[A-Za-z0-9_\-+/.!]{6,}+)[\"']?\s*")
#: A private key's lines after its head line and headers; only the last word before the end line may be short.
_BLOCK = re.compile(
    rf"{_BLOCK_HEAD}[A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----[ \t]*+(?:\r?\n[A-Za-z\-]++:[^\n]*+)*+"
    r"(?P<key>(?:\s*+[A-Za-z0-9+/=]{16,}+)++(?:\s*+[A-Za-z0-9+/=]{1,15}+(?=\s*+-----END))?)"
)
#: Phones have a country prefix, or an area in brackets, or a national plan in its common grouping.
_PHONE = (
    rf"(?<![0-9])\+1[ .\-]?\(?[0-9]{{3}}\)?[ .\-]?[0-9]{{3}}[ .\-]?[0-9]{{4}}{_END}"
    rf"|(?<![0-9])\+[0-9](?:\)?[ .\-]?\(?[0-9]){{7,14}}{_END}"
    rf"|(?<![0-9A-Za-z])(?<![0-9][.\-,/])(?:(?:1[ .\-]?)?\([0-9]{{3}}\)[ .\-]?[0-9]{{3}}[ .\-]?[0-9]{{4}}"  # in brackets
    rf"|\(0[0-9]{{1,4}}\)[ .\-]?[0-9]{{2,4}}(?:[ .\-]?[0-9]{{2,4}}){{1,2}}|\([1-9][0-9]\)[ .\-]?9?[0-9]{{4}}-[0-9]{{4}}"
    rf"|(?:1[ .\-])?[2-9][0-9]{{2}}(?P<p1>[ .\-])[2-9][0-9]{{2}}(?P=p1)[0-9]{{4}}"  # North America
    rf"|0[1-9](?P<p2>[ .\-]?)[0-9]{{2}}(?:(?P=p2)[0-9]{{2}}){{3}}"  # France
    rf"|[6-9][0-9]{{2}}(?P<p3>[ .\-])[0-9]{{2}}(?P=p3)[0-9]{{2}}(?P=p3)[0-9]{{2}}"  # Spain
    rf"|0[1-9][0-9]{{1,3}}[ \-/][0-9]{{3,4}}[ \-]?[0-9]{{3,4}})(?![0-9A-Za-z]|[.\-,/][0-9])"  # Britain, Germany
)
_VALUE = re.compile(
    rf"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++"
    rf"(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{{2,}}(?![A-Za-z0-9]))"
    rf"|(?P<secret>{_EDGE}(?:(?P<cloud>AKIA[0-9A-Z]{{16}}){_END}|(?:0x)?(?P<hex>[0-9a-f]{{32,}}+){_END}"
    rf"|(?P<signed>(?<![_\-.])eyJ[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}+)"
    rf"|{_KEYWORD}\s{{0,4}}[=:]\s{{0,4}}[\"']?"
    rf"(?P<value>[A-Za-z0-9_\-+/.!]{{6,}})))"
    rf"|(?P<iban>{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?{_END})"
    rf"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9]))"
    rf"|(?P<date>{_EDGE}(?P<d1>[0-9]{{4}}(?=[\-/.][0-9]{{1,2}}[\-/.][0-9]{{1,2}}{_END})"
    rf"|[0-9]{{1,2}}(?=[\-/.][0-9]{{1,2}}[\-/.][0-9]{{4}}{_END}))"
    rf"(?P<sep>[\-/.])(?P<d2>[0-9]{{1,2}})(?P=sep)(?P<d3>[0-9]{{1,4}}){_END})"
    rf"|(?P<ssn>(?<![0-9A-Za-z\-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z\-]))"
    rf"|(?P<card>(?<![0-9A-Za-z.\-])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ \-][0-9]{{4}}){{2,3}}(?:[ \-][0-9]{{1,3}})?"
    rf"|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{5}}){_END})"
    rf"|(?P<phone>{_PHONE})"
)


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with text rewritten, and n_email, n_phone, ... (the values replaced, by kind)."""
    others = docs.drop("__text", *[f"n_{k}" for k in KINDS]).withColumn("__text", F.col("text"))
    kept = [f for f in others.schema.fields if f.name != "__text"]
    place = [f.name for f in kept].index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += "".join(f", n_{k} int" for k in KINDS)

    def run(batches):
        names = Pseudonyms(key)
        for batch in batches:
            out, counts = [], []
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py()
                new, found = (None, {}) if text is None else names.text(text)
                out.append(new)
                counts.append(found)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(out, batch.column(batch.num_columns - 1).type)
            columns += [pa.array([c.get(k, 0) for c in counts], pa.int32()) for k in KINDS]
            names_out = [*batch.schema.names[:-1], *[f"n_{k}" for k in KINDS]]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return others.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
