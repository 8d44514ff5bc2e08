"""PII: format-preserving Feistel pseudonyms.

Values that pass validation (card numbers, phone numbers, IP addresses, mail addresses, social security numbers, IBANs,
dates) are permuted under a key within the values of their format, so that equal values have equal pseudonyms in all
documents, no state is shared, and a valid value stays valid.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import logging
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import slices, small_batches, spare, table, without

ROUNDS = 10
#: the session setting that holds the key of the query and the pipeline's stage
KEY_SETTING = "spark.thicket.pii.key"
#: what they use where the setting is absent, as on the synthetic tables: no secret, so its pseudonyms can be turned back
OPEN_KEY = "open key for synthetic tables"
log = logging.getLogger("thicket")


def session_key(spark: SparkSession) -> bytes:
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        log.warning("%s is not set: pseudonyms are made with an open key", KEY_SETTING)
    return (key or OPEN_KEY).encode()


class Feistel:
    """A keyed permutation of 0 .. n-1: an unbalanced Feistel network over a * b >= n, walked until the result is below n."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.a = max(1, math.isqrt(n - 1) + 1) if n > 1 else 1
        self.b = -(-n // self.a)
        self.key = hashlib.blake2b(key, digest_size=32, person=tweak.encode()[:16]).digest()
        self.tweak = f"{tweak}:{n}:".encode()

    def _mix(self, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(self.tweak + b"%d:%d" % (i, half), key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._mix(i, left)) % self.b
            else:
                left = (left + self._mix(i, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int) -> int:
        y = self._once(x)
        while y >= self.n:
            y = self._once(y)
        return y


def permute(x: int, n: int, tweak: str, key: bytes, valid: Callable[[int], bool] = lambda y: True) -> int:
    """x's image among the valid numbers below n; x must be valid, so the walk ends. The image of one value may be itself, as in any permutation."""
    f = Feistel(key, tweak, n)
    y = f(x)
    while not valid(y):
        y = f(y)
    return y


def check_digit(payload: str) -> int:
    """The Luhn digit that follows the payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(value: str, key: bytes) -> str | None:
    """13 to 19 digits with a right Luhn digit: the others are permuted, and the Luhn digit follows."""
    d = re.sub(r"\D", "", value)
    if not 13 <= len(d) <= 19 or check_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), "card", key)).zfill(len(d) - 1)
    return refill(value, body + str(check_digit(body)))


def phone(value: str, key: bytes) -> str | None:
    """North American numbers of ten digits: those whose area code and exchange start with 2 to 9 stay so, as do the others. Others with + and 8 to 15 digits keep the first two."""
    d = re.sub(r"\D", "", value)
    if value.startswith("+") and not d.startswith("1"):
        return refill(value, d[:2] + str(permute(int(d[2:]), 10 ** (len(d) - 2), "phone", key)).zfill(len(d) - 2)) if 8 <= len(d) <= 15 else None
    head, body = d[:-10], d[-10:]
    if len(body) != 10 or head not in ("", "1"):
        return None
    given = lambda y: (s := f"{y:010d}")[0] in "23456789" and s[3] in "23456789"
    kind = given(int(body))
    return refill(value, head + f"{permute(int(body), 10**10, 'phone', key, lambda y: given(y) == kind):010d}")


def ip(value: str, key: bytes) -> str | None:
    """Four numbers up to 255 without leading zeros, as one number of 32 bits."""
    parts = value.split(".")
    if len(parts) != 4 or any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    return str(ipaddress.IPv4Address(permute(int(ipaddress.IPv4Address(value)), 2**32, "ip", key)))


def ssn(value: str, key: bytes) -> str | None:
    """ddd-dd-dddd outside the ranges that are never given."""
    fits = lambda y: not ((s := f"{y:09d}")[:3] in ("000", "666") or s[0] == "9" or s[3:5] == "00" or s[5:] == "0000")
    d = int(value.replace("-", ""))
    return refill(value, f"{permute(d, 10**9, 'ssn', key, fits):09d}") if fits(d) else None


def date(value: str, key: bytes) -> str | None:
    """A real day from 1900 to 2099, year first or last; day.month.year and month/day/year. It becomes another such day in the same notation."""
    sep = next(c for c in value if not c.isdigit())
    parts = value.split(sep)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 0, 1) if sep == "/" else (2, 1, 0)
    try:
        day = datetime.date(*(int(parts[i]) for i in order))
    except ValueError:
        return None
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    if not first <= day.toordinal() <= last:
        return None
    new = datetime.date.fromordinal(first + permute(day.toordinal() - first, last - first + 1, "date", key))
    made = [""] * 3
    for i, x in zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"), strict=True):
        made[i] = x
    return sep.join(made)


def letters(value: str, tweak: str, key: bytes) -> str:
    """Each ASCII digit, small and capital letter is replaced by one of its kind; all of them together are one number in mixed radix."""
    kinds = [(48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else None for c in value]
    n, x = 1, 0
    for c, k in zip(value, kinds, strict=True):
        if k:
            n, x = n * k[1], x * k[1] + ord(c) - k[0]
    # the places of a long value do not fit a hash at once, so it goes through in chunks, each under what stands before it
    if n > 2**200:
        half = len(value) // 2
        a = letters(value[:half], tweak, key)
        return a + letters(value[half:], f"{hashlib.blake2b(a.encode(), digest_size=6).hexdigest()}{tweak}", key)
    y = permute(x, n, tweak, key) if n > 1 else 0
    out = []
    for c, k in zip(reversed(value), reversed(kinds), strict=True):
        if k:
            y, d = divmod(y, k[1])
            c = chr(k[0] + d)
        out.append(c)
    return "".join(reversed(out))


def mail(value: str, key: bytes) -> str | None:
    """Name and host are permuted; the top-level domain and all punctuation stay."""
    name, _, host = value.rpartition("@")
    host, dot, top = host.rpartition(".")
    return f"{letters(name, 'name', key)}@{letters(host, 'host', key)}{dot}{top}" if name and host and 2 <= len(top) else None


def iban(value: str, key: bytes) -> str | None:
    """A right remainder by 97: country and length stay, the rest is permuted, and the check digits follow."""
    remainder = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if not 15 <= len(value) <= 34 or remainder(value[4:] + value[:4]) != 1:
        return None
    body = letters(value[4:], "iban", key)
    return f"{value[:2]}{98 - remainder(body + value[:2] + '00'):02d}{body}"


#: kind, pattern and pseudonym, in the order in which they are tried at a place
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("mail", r"(?<![\w.+%-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])", mail),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)", iban),
    ("date", r"(?<![\w.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[-./]\d)", date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ip),
    ("phone", r"(?<![\w+])(?:\+1[ .-]?|(?<!\.)1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)", phone),
    ("card", r"(?<![\w.-])\d{13,19}(?!\w|[.-]\d)", card),
    ("card", r"(?<![\w.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|[.-]\d)", card),
)
#: a text that lacks this has none of the kinds
ANY = re.compile(r"[0-9@]")


class Pseudonyms:
    """text -> (new text, spans replaced by kind)."""

    def __init__(self, key: bytes):
        self.key = key
        self.patterns = [(kind, re.compile(p, re.ASCII), f) for kind, p, f in KINDS]
        self.memory: dict[tuple[str, str], str | None] = {}

    def _of(self, kind: str, f: Callable, value: str) -> str | None:
        if len(self.memory) > 50_000:
            self.memory.clear()
        k = (kind, value)
        if k not in self.memory:
            self.memory[k] = f(value, self.key)
        return self.memory[k]

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """Spans count code points of the old text. Where two kinds overlap, the one earlier in KINDS has it."""
        if not ANY.search(text):
            return text, []
        found: list[tuple[int, int, str, str]] = []
        for kind, pattern, f in self.patterns:
            if kind == "mail" and "@" not in text:
                continue
            # found is sorted and without overlaps, as are a kind's own matches: both are walked once, and merged
            own, at = [], 0
            for m in pattern.finditer(text):
                a, b = m.span()
                while at < len(found) and found[at][1] <= a:
                    at += 1
                if (at == len(found) or b <= found[at][0]) and (new := self._of(kind, f, m[0])) is not None:
                    own.append((a, b, kind, new))
            if own:
                found = sorted(found + own)
        if not found:
            return text, []
        out, at = [], 0
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


def pseudonymise(docs: DataFrame, keep: list[str], key: bytes, text: str = "text", spans: str = "_found") -> DataFrame:
    """The columns `keep`, the new text as `text`, and `spans` (array of kind, begin, end of the old text); columns of those two names are replaced.

    Null texts stay null. Texts without a valid value stay as they are, byte for byte; whole texts are searched, however
    long. Rows are independent, so repeated rows, ties and null ids need no care; no rows: no rows. The key belongs to whoever
    may link or turn back values.
    """
    keep = without(keep, (text, spans))
    text_, new_ = spare([*docs.columns, spans], "_text", "_new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, text_):
            got = [(None, []) if t is None else change(t) for t in batch.column(text_).to_pylist()]
            where = pa.array([[{"kind": k, "begin": a, "end": b} for k, a, b in s] for _, s in got], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([t for t, _ in got], pa.string()), where], [*keep, new_, spans])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    made = docs.select(*keep, F.col(text).alias(text_)).mapInArrow(run, ", ".join([*kinds, f"`{new_}` string, `{spans}` array<struct<kind:string,begin:int,end:int>>"]))
    return made.withColumnRenamed(new_, text)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_found, counts by kind) of every document; see pseudonymise for odd rows."""
    small_batches(spark)
    out = pseudonymise(table(spark, sf_dir, "documents"), ["doc_id"], session_key(spark))
    count = lambda k: F.size(F.filter("_found", lambda x: x["kind"] == k)).alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("_found").alias("n_found"), *(count(k) for k in dict.fromkeys(k for k, _, _ in KINDS)))
