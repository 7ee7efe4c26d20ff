"""Personal data replaced by format-preserving Feistel pseudonyms.

Found values that pass the check of their kind (Luhn, mod 97, calendar, ranges) become numbers below the size of their
format, are permuted there by a keyed Feistel network, and are written in the same format again. A permutation keeps
equal values equal and different ones different, so mentions stay linked across documents and tasks without a table;
the holder of the key can reverse it. A permuted number outside the format is permuted again until it is inside (cycle
walking), which is still a permutation of the format. Each kind has its own permutation of each format size.
"""

import datetime
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import in_slices, text_bytes

ROUNDS = 10
#: Only for tests and for the registered query; a real corpus needs a secret of its own.
EXAMPLE_KEY = b"example key, not a secret"


class Permutation:
    """Keyed permutation of the whole numbers below a size."""

    def __init__(self, key: bytes):
        self.key = len(key).to_bytes(4, "big") + key

    def _mixed(self, kind: str, size: int, turn: int, half: int, bits: int) -> int:
        head = f"{kind}|{size}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.shake_256(self.key + head).digest((bits + 7) // 8), "big") & ((1 << bits) - 1)

    def _network(self, kind: str, size: int, value: int, reverse: bool) -> int:
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        left, right = value >> bits, value & ((1 << bits) - 1)
        for turn in range(ROUNDS - 1, -1, -1) if reverse else range(ROUNDS):
            if reverse:
                left, right = right ^ self._mixed(kind, size, turn, left, bits), left
            else:
                left, right = right, left ^ self._mixed(kind, size, turn, right, bits)
        return left << bits | right

    def move(self, kind: str, size: int, value: int, reverse: bool = False, good=None) -> int:
        """The number that takes the place of `value`. `good` narrows the format: it holds for `value`, and will for
        the result."""
        while True:
            value = self._network(kind, size, value, reverse)
            if value < size and (good is None or good(value)):
                return value


def luhn_digit(payload: str) -> int:
    """The digit that makes the payload with it a valid card number."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(payload)))
    return -total % 10


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    take = iter(digits)
    return re.sub(r"\d", lambda _: next(take), text)


def _card(text, move):
    digits = _digits(text)
    payload = digits[:-1]
    if int(digits[-1]) != luhn_digit(payload):
        return None
    new = f"{move('card', 10 ** len(payload), int(payload)):0{len(payload)}d}"
    return _refill(text, new + str(luhn_digit(new)))


def _phone(text, move):
    digits = _digits(text)
    if not 9 <= len(digits) <= 15:
        return None
    # The country code or trunk digit, as far as it is set apart, is part of the format.
    code = len(_digits(m[0])) if (m := re.match(r"\+\d{1,3}(?=[ .(-])|1(?=[ .-])", text)) else 0
    rest = digits[code:]
    return _refill(text, digits[:code] + f"{move(f'phone{code}', 10 ** len(rest), int(rest)):0{len(rest)}d}")


def _address(text, move):
    parts = [int(x) for x in text.split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    return ".".join(str(x) for x in move("ip", 1 << 32, int.from_bytes(bytes(parts), "big")).to_bytes(4, "big"))


def _social_good(value: int) -> bool:
    area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _social(text, move):
    value = int(_digits(text))
    return _refill(text, f"{move('social', 10**9, value, _social_good):09d}") if _social_good(value) else None


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def _date(text, move):
    mark = next(c for c in text if not c.isdigit())
    a, b, c = text.split(mark)
    if len(a) == 4:
        order, fields = "ymd", (a, b, c)
    else:
        order, fields = ("dmy", (c, b, a)) if int(b) <= 12 else ("mdy", (c, a, b))
    try:
        day = datetime.date(*map(int, fields)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    wide = dict(zip(order, map(len, (a, b, c))))

    # A date that can only be month first stays one that can only be month first; a field of one digit stays one.
    def good(v):
        new = datetime.date.fromordinal(_FIRST_DAY + v)
        return (order != "mdy" or new.day > 12) and (wide["d"] > 1 or new.day < 10) and (wide["m"] > 1 or new.month < 10)

    kind = f"date-{order}" + "".join(f"-{x}" for x in "dm" if wide[x] == 1)
    new = datetime.date.fromordinal(_FIRST_DAY + move(kind, _DAYS, day, good))
    written = {"y": f"{new.year:04d}", "m": f"{new.month:0{wide['m']}d}", "d": f"{new.day:0{wide['d']}d}"}
    return mark.join(written[x] for x in order)


_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_HEX = ["0123456789abcdef"]


def _by_class(kind: str, text: str, move, classes=_CLASSES) -> str:
    """Every digit becomes a digit, every small letter a small letter and so on; other characters stay."""
    of = [next((c for c in classes if x in c), None) for x in text]
    size, value = 1, 0
    for x, c in zip(text, of):
        if c:
            size, value = size * len(c), value * len(c) + c.index(x)
    if size == 1:
        return text
    value = move(f"{kind}:{''.join(str(classes.index(c)) if c else x for x, c in zip(text, of))}", size, value)
    out = []
    for x, c in zip(reversed(text), reversed(of)):
        if c:
            value, place = divmod(value, len(c))
            x = c[place]
        out.append(x)
    return "".join(reversed(out))


def _check_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _account(text, move):
    plain = re.sub(r"[ -]", "", text)
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if check != _check_digits(country, rest):
        return None
    rest = _by_class("account" + country, rest, move)
    take = iter(country + _check_digits(country, rest) + rest)
    return re.sub(r"[^ -]", lambda _: next(take), text)


def _mail(text, move):
    local, _, domain = text.rpartition("@")
    return _by_class("mail", local, move) + "@" + domain


def _secret(text, move):
    # Marks of the sentence after a secret are no part of it.
    head, value, tail = re.fullmatch(r"(.*?[:=][ ]?[\"']?)(.*?)([.,;:!?)\]}>]*)", text, re.S).groups()
    if not re.search(r"[0-9A-Za-z]", value):
        return None
    return head + _by_class("secret", value, move, _HEX if re.fullmatch(r"[0-9a-f]+", value) else _CLASSES) + tail


#: Lengths of account numbers by country, for those printed in groups: where such a number ends. Fixed values.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, c in ACCOUNT_LENGTHS.items())

#: Kinds in order of precedence: pattern, and the function that gives the pseudonym, or None for what fails its check.
KINDS = [
    ("secret", r"\b(?i:password|passwd|secret|token|api[_-]?key)[ ]?[:=][ ]?(?:\"[^\"\n]{8,}(?=\")|'[^'\n]{8,}(?=')|[\"']?[^\s\"']{8,})", _secret),
    ("mail", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _mail),
    ("account", rf"\b(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{_GROUPED})\b", _account),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d(?:[ .()-]{0,2}\d){8,14}(?!\d)|(?<!\w)\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w-])|(?<![\w.-])(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}(?![\w-]|\.\d)", _phone),
    ("card", r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![0-9A-Za-z])", _card),
    ("social", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _social),
    ("address", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _address),
    ("date", r"(?<![\w/.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?:(?=T\d{1,2}:?\d{2})|(?![\w/-]|\.\d))", _date),
]
_COMPILED = [(name, re.compile(pattern, re.ASCII), replace) for name, pattern, replace in KINDS]


def pseudonymised(text: str, key: bytes, reverse: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its personal data replaced, and (kind, start, end) of each in the given text."""
    network = Permutation(key)
    taken: list[tuple[int, int, str, str]] = []
    for name, pattern, replace in _COMPILED:
        for m in pattern.finditer(text):
            if any(m.start() < e and s < m.end() for s, e, *_ in taken):
                continue
            new = replace(m[0], lambda kind, size, value, good=None: network.move(kind, size, value, reverse, good))
            if new is not None:
                taken.append((m.start(), m.end(), name, new))
    taken.sort()
    parts, at = [], 0
    for start, end, _, new in taken:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), [(name, start, end) for start, end, name, _ in taken]


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"0123456789@=:")] = True


def _replace_all(texts: pa.Array, key: bytes, reverse: bool) -> pa.Array:
    data, offsets = text_bytes(texts)
    signs = np.concatenate(([0], np.cumsum(_SIGNS[data])))[offsets]
    out: list[str | None] = texts.to_pylist()
    found: list[list[dict]] = [[] for _ in out]
    for row in np.flatnonzero(np.diff(signs)).tolist():
        out[row], places = pseudonymised(out[row], key, reverse)
        found[row] = [{"kind": k, "start": s, "end": e} for k, s, e in places]
    spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), spans], ["text", "found"])


def pseudonyms_of(key: bytes = EXAMPLE_KEY, reverse: bool = False):
    """A column function of a text column: struct of text (with pseudonyms) and found (kind, start and end in
    characters of the given text). Null stays null, empty stays empty, values that fail their check stay as they are.
    `reverse` gives the original values back to the holder of the key."""

    @F.arrow_udf("text string, found array<struct<kind: string, start: long, end: long>>")
    def replace(texts: pa.Array) -> pa.Array:
        return in_slices(lambda t: _replace_all(t, key, reverse), texts)

    return replace


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY) -> DataFrame:
    """All rows and columns with personal data in `text` replaced, and n_chars, if it is there, counted anew for the
    changed ones. Equal values get equal pseudonyms in all documents."""
    name = "_pseudonyms"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, pseudonyms_of(key)("text"))
    changed = {"text": F.col(f"{name}.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        some = F.size(f"{name}.found") > 0
        changed["n_chars"] = F.when(some, F.length(F.col(f"{name}.text")).cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).drop(name)


def pseudonym_report(docs: DataFrame, key: bytes = EXAMPLE_KEY) -> DataFrame:
    """doc_id, text (with pseudonyms), n_found, kinds (their names, sorted, comma-joined) for every row."""
    found = docs.select("doc_id", pseudonyms_of(key)("text").alias("p"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("p.found", lambda x: x["kind"]))), ",")
    return found.select("doc_id", "p.text", F.size("p.found").cast("long").alias("n_found"), kinds.alias("kinds"))
