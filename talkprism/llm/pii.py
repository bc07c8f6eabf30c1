"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Numbers and dates that pass their own validity test are replaced by others of the same format
that pass it too. Each value is read as a number of its format's domain, permuted there by a
balanced Feistel network with a keyed hash as round function, walked on while the result is not
valid, and written back with the same separators. The permutation depends on the key and the
kind alone, so equal values get equal pseudonyms in all documents, different ones different
pseudonyms, and ``reveal`` inverts it with the key.

Kinds: payment cards (Luhn), IBAN (mod 97), telephone numbers, social security numbers, IPv4
addresses, e-mail addresses (letters and digits of the local part, class by class), dates.

A long local part is permuted block by block, each block keyed by those before it, so numbers
stay small. E-mail addresses are searched from each @ and digit runs are read once, so a text
costs time in proportion to its length, unbroken runs of letters or digits among them.

Defined cases: a null text stays null, an empty one empty; a very long text is read whole; rows
are treated one by one, so ties, repeated rows, null ids and other columns don't matter; an empty
table gives an empty result; a text without valid values is returned unchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
#: The key of the queries; a deployment gives its own.
KEY = b"talkprism pseudonyms, test key"
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())

PATTERN = re.compile(
    r"""
    (?P<iban>\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b)
    |(?P<date>(?<![\w.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![\w]|\.[0-9]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9]))
    |(?P<phone>(?<![\w.+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![\w]|-[0-9])|(?<!\w)\+[0-9]{8,15}(?!\w))
    """,
    re.X,
)
#: A digit run that may hold cards; where a word character follows, its last group is not part of it.
CARDS = re.compile(r"(?<![\w.+-])[0-9](?:[\x20-]?[0-9]){12,}+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Characters of a local part that are permuted together.
EMAIL_BLOCK = 64


def _round(state, r: int, value: int, width: int) -> int:
    """The round function: a keyed hash of the round and the half's bytes, as long as the half and 16 bytes, so sums modulo the half are near uniform."""
    h = state.copy()
    h.update(bytes([r]) + value.to_bytes(width, "big"))
    seed = h.digest()
    return int.from_bytes(seed if width <= 16 else hashlib.shake_256(seed).digest(width + 16), "big")


def permute(x: int, size: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: Feistel on the next square, walked back into the domain."""
    half = math.isqrt(size - 1) + 1
    width = (half.bit_length() + 7) // 8
    state = hashlib.blake2b(kind.encode("utf-8", "surrogatepass") + b"/" + size.to_bytes((size.bit_length() + 7) // 8, "big") + b"/", key=key[:64], digest_size=32)
    while True:
        a, b = divmod(x, half)
        for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                a, b = (b - _round(state, r, a, width)) % half, a
            else:
                a, b = b, (a + _round(state, r, b, width)) % half
        x = a * half + b
        if x < size:
            return x


def walk(x: int, size: int, valid: Callable[[int], bool], key: bytes, kind: str, inverse: bool) -> int:
    """The permutation of the valid numbers that the one of all numbers induces."""
    while True:
        x = permute(x, size, key, kind, inverse)
        if valid(x):
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


#: Group sizes in which cards are written; they are preferred to other readings of a digit run.
_LAYOUTS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))})


def _reading(d: list[str], ends: list[int], g: int) -> int | None:
    """The group at which a card that starts with group ``g`` of the digits ends (exclusive), or None. ``ends``: 0 and where each group ends."""

    def valid(i: int, known: bool) -> int | None:
        for j in range(min(len(ends) - 1, i + 19), i, -1):
            if not 13 <= ends[j] - ends[i] <= 19:
                continue
            own = "".join(d[ends[i] : ends[j]])
            layout = tuple(b - a for a, b in zip(ends[i:j], ends[i + 1 : j + 1], strict=True)) in _LAYOUTS
            if layout == known and luhn(own) and own.strip("0"):
                return j
        return None

    found = valid(g, True)
    if found is None and (found := valid(g, False)) is not None and any(valid(i, True) for i in range(g + 1, found)):
        return None
    return found


def _cards(text: str, key: bytes, inverse: bool) -> tuple[str, int, int]:
    """A digit run with its cards replaced, their number and the end of the last one.

    Every group may start a card and every later one end it. A pseudonym after which the run
    would be read otherwise is walked past, so the new run has its cards in the same places.
    """
    ends = [0]
    for group in re.findall("[0-9]+", text):
        ends.append(ends[-1] + len(group))
    d, g, read = list(_digits(text)), 0, []
    while g < len(ends) - 1:
        read.append((g, _reading(d, ends, g)))
        g = read[-1][1] or g + 1
    found = [(k, a, b) for k, (a, b) in enumerate(read) if b]
    for k, a, b in reversed(found) if inverse else found:
        i, j = ends[a], ends[b]
        n = j - i - 2  # the first digit stays, the last makes the sum right
        near = k
        while near and ends[read[near - 1][0]] > i - 38:  # a reading looks at most two cards ahead
            near -= 1
        first, x = d[i], int("".join(d[i + 1 : j - 1]))

        def fits(x: int) -> bool:
            body = f"{first}{x:0{n}d}"  # noqa: B023
            d[i:j] = next(body + c for c in "0123456789" if luhn(body + c))  # noqa: B023
            return bool(x or first != "0") and all(_reading(d, ends, s) == e for s, e in read[near : k + 1])  # noqa: B023

        walk(x, 10**n, fits, key, f"card{n}{first}", inverse)  # the number that fits is left in d
    places = [m.end() for m in re.finditer("[0-9]+", text)]
    return _refill(text, "".join(d)), len(found), places[found[-1][2] - 1] if found else len(text)


def _iban(text: str, key: bytes, inverse: bool) -> str | None:
    packed = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(packed) <= 34 or number(packed[4:] + packed[:4]) % 97 != 1:
        return None
    places = [i for i in range(4, len(packed)) if packed[i].isdigit()]
    if not places:
        return None
    n = len(places)
    new = list(packed)
    for i, c in zip(places, f"{permute(int(''.join(packed[i] for i in places)), 10**n, key, f'iban{n}', inverse):0{n}d}", strict=True):
        new[i] = c
    rest = "".join(new[4:])
    new[2:4] = f"{98 - number(rest + packed[:2] + '00') % 97:02d}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    prefix = re.match(r"\+[0-9]{1,3}(?=[\x20.(-])|", text)[0]
    d = _digits(text[len(prefix) :])
    if not 7 <= len(d) + len(_digits(prefix)) <= 15 or len(d) < 6:
        return None
    n, american = len(d), prefix in ("+1", "") and len(d) == 10
    whole = lambda x: f"{x:0{n}d}"
    # What tells one numbering plan from another stays, so a pseudonym is read as its number was.
    shape = lambda s: (s[0] == "0", american and s[0] > "1" and s[3] > "1")
    fits = lambda x: shape(whole(x)) == shape(d)
    return prefix + _refill(text[len(prefix) :], whole(walk(int(d), 10**n, fits, key, f"phone{n}", inverse)))


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    fits = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 > 0 and x % 10**4 > 0
    if not fits(int(_digits(text))):
        return None
    return _refill(text, f"{walk(int(_digits(text)), 10**9, fits, key, 'ssn', inverse):09d}")


def _ip(text: str, key: bytes, inverse: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    x = walk(int.from_bytes(bytes(parts), "big"), 1 << 32, lambda v: True, key, "ip", inverse)
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def _email(text: str, key: bytes, inverse: bool) -> str | None:
    local, domain = text.split("@", 1)
    out, tweak = [], domain
    for i in range(0, len(local), EMAIL_BLOCK):
        block = local[i : i + EMAIL_BLOCK]
        new = _permute_letters(block, key, "email" + tweak, inverse)
        out.append(new)
        # The next block's permutation depends on all that came before it, in clear.
        tweak = hashlib.blake2b((tweak + "@" + (new if inverse else block)).encode(), digest_size=16).hexdigest()
    new = "".join(out)
    return new + "@" + domain if any(c.isalnum() for c in local) else None


def _permute_letters(block: str, key: bytes, kind: str, inverse: bool) -> str:
    """A text of the same length with lower-case letters, capitals and digits in the same places."""
    classes = [("a", 26) if c.islower() else ("A", 26) if c.isupper() else ("0", 10) if c.isdigit() else (c, 1) for c in block]
    size, x = 1, 0
    for c, (base, n) in zip(block, classes, strict=True):
        size, x = size * n, x * n + (ord(c) - ord(base))
    if size < 2:
        return block
    x, out = permute(x, size, key, kind + "/" + "".join(b for b, _ in classes), inverse), []
    for base, n in reversed(classes):
        x, c = divmod(x, n)
        out.append(chr(ord(base) + c))
    return "".join(reversed(out))


def _date(text: str, key: bytes, inverse: bool) -> str | None:
    sign = text[4] if text[4] in "-/" else text[2]
    orders = [f"%Y{sign}%m{sign}%d"] if text[4] in "-/" else [f"%d{sign}%m{sign}%Y", f"%m{sign}%d{sign}%Y"][:: -1 if sign == "/" else 1]
    size = _DAYS[1] - _DAYS[0] + 1
    for k, kind in enumerate(orders):
        x = _day(text, kind)
        if x is None or not 0 <= x < size:
            continue
        # In the second order only dates that the first can't read, so the order found is found again.
        fits = lambda x: not k or _day(datetime.date.fromordinal(x + _DAYS[0]).strftime(kind), orders[0]) is None  # noqa: B023, E731
        return datetime.date.fromordinal(walk(x, size, fits, key, "date", inverse) + _DAYS[0]).strftime(kind)
    return None


def _day(text: str, kind: str) -> int | None:
    try:
        return datetime.datetime.strptime(text, kind).date().toordinal() - _DAYS[0]
    except ValueError:
        return None


_MAKERS = {"email": _email, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}
_HINT = re.compile("[0-9@]")
_GROUP = re.compile(r"\W?\w+")
_INNER = re.compile(r"(?<![\w.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4}|(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w]|-[0-9])")


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, at, end) of each e-mail address: start is that of the local part's run, its first letter or digit is found later."""
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, at, domain.end()
        at = text.find("@", at + 1)


def _card_run(text: str, start: int) -> tuple[int, int] | None:
    """(start, end) of the next digit run that may hold cards."""
    while m := CARDS.search(text, start):
        start, end = m.span()
        if end == len(text) or not (text[end].isalnum() or text[end] == "_"):
            return start, end
        end = max(text.rfind(" ", start, end), text.rfind("-", start, end))
        if end > start and len(_digits(text[start:end])) > 12:
            return start, end
        start = m.end()  # no later start in the run has more digits
    return None


def _first_letter(text: str, start: int, at: int) -> int | None:
    return next((i for i in range(start, at) if text[i] not in "._%+-"), None)


def pseudonymise(text: str | None, key: bytes = KEY, inverse: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with its valid values replaced, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not text or not _HINT.search(text):
        return text, counts

    out, done = [], 0
    emails = _emails(text)
    email, other, run = next(emails, None), PATTERN.search(text), _card_run(text, 0)
    while True:
        while email and (email[1] <= done or _first_letter(text, max(done, email[0]), email[1]) is None):
            email = next(emails, None)
        if other and other.start() < done:
            other = PATTERN.search(text, done)
        if run and run[0] < done:
            run = _card_run(text, done)
        # The leftmost value comes first; at one place an address, then the bounded kinds but telephone, then cards.
        places = []
        if email:
            places.append((_first_letter(text, max(done, email[0]), email[1]), 0, "email"))
        if other:
            places.append((other.start(), 3 if other.lastgroup == "phone" else 1, other.lastgroup))
        if run:
            places.append((run[0], 2, "card"))
        if not places:
            break
        start, _, kind = min(places)
        if kind == "card":
            end = run[1]
            inner = _INNER.search(text, start, end)  # a date or number of another format ends the run
            end = inner.start() - 1 if inner and inner.start() > start else end
            value, n, last = _cards(text[start:end], key, inverse)
            counts["card"] += n
            out += [text[done:start], value[:last]]
            done = start + last
            continue
        end = email[2] if kind == "email" else other.end()
        value = _MAKERS[kind](text[start:end], key, inverse)
        if value is not None:
            counts[kind] += 1
        else:  # what follows the first group may be valid
            end = _GROUP.match(text, start).end()
            value = text[start:end]
        out += [text[done:start], value]
        done = end
    return "".join([*out, text[done:]]), counts


def reveal(text: str | None, key: bytes = KEY) -> str | None:
    return pseudonymise(text, key, inverse=True)[0]


def _replacer(key: bytes):
    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]]))
    def replace(texts: pd.Series) -> pd.DataFrame:
        rows = [(t, *c.values()) for t, c in (pseudonymise(t, key) for t in texts)]
        return pd.DataFrame(rows, columns=["text", *[f"n_{k}" for k in KINDS]])

    return replace


def with_pseudonyms(docs: DataFrame, text: str = "text", into: str = "pseudonymised", key: bytes = KEY) -> DataFrame:
    """``docs`` with a struct column ``into``: the new text and the number of values of each kind."""
    return docs.withColumn(into, _replacer(key)(F.col(text)))
