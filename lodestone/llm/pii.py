"""Personal data: base patterns, and boosted trees over the candidates of high-recall generators.

Base spans (email, ip, card, phone) are what their patterns match and their checks accept. Besides,
generators propose overlapping candidates, with digits or without and of any length: the value after
``=``, ``:`` or a spoken ``is``, runs that no plain word looks like, runs of digits, addresses spelt
with words, account numbers, key blocks. What a check sum, an issuer's prefix, a key block's frame or
the top-level domain of a spelt address proves is added as it is.

Everything else is decided by two ensembles of boosted trees that teach each other, each blind to
what labels its training: one sees the format of a value alone and learns from what context tells
(``password =`` before it, nothing of the kind before it); the other sees the context alone, with the
log-odds of the words before a value counted in the sample, and learns from what formats tell (proven
or random-looking values, plain words, dates, short numbers; after ``commit`` and the like nothing is
personal). The sum of their margins is held against a threshold for each kind that no more than 1 in
200 labelled negatives of all texts, whole, exceed.
So a random value after a word that is in no list is found, and so is a plain word after one that is.

Bounds, both parameters: trees are fitted on the candidates of at most ``texts`` whole texts by the
hash of their ids, at most ``most`` that some view calls personal and ``most`` others by the hash of
what they are. The candidates of ``prior_texts``, some hundreds that the lists of words make, join
these at every size, so trees and thresholds exist for the smallest table and the corpus outweighs the
prior as it grows.
Base spans always stay; an added span that overlaps a base span or a better added one is dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, hash_unit, materialize, record_batch
from lodestone.llm.boosting import FlatTrees, fit

#: Texts whose candidates trees are trained on, at most, and candidates of either label, at most.
TRAINING_TEXTS = 20_000
TRAINING_CANDIDATES = 30_000
#: Bins of the summed margins that thresholds are read from, over [-ODDS, ODDS]; rows are kinds times bins whatever the input.
BINS = 4096
ODDS = 24.0
#: Least threshold: log-odds of 0.6.
LEAST_ODDS = 0.4
#: Values that the prior draws for each word of the lists.
PRIOR_DRAWS = 4
#: Words before a value with fewer labelled values in the sample have no log-odds of their own.
LEAST_WORD = 3
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "contact", "identifier")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins with a whole run of digits or not at all, so no run is read more often than it has neighbours.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the email pattern, found from each ``@``."""
    found, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            least = domain.end()
        at = text.find("@", max(at + 1, least))
    return found


def base_spans(text: str) -> list[Span]:
    """Base spans by kind and then by start; matches that fail their check are dropped, without a second try."""
    spans: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return spans


# Generators of candidates. Each reads a text once; what they propose is as long as it is.
#: A key is a whole run of letters of any script, digits and ``_.-`` from its first letter on, so ``--password`` is one.
_KEYED = re.compile(r"(?<![\w.-])[0-9_.-]*+([^\W\d_][\w.-]*+)[\"']?\s{0,3}(=>|:=|[=:\uFF1A])\s{0,3}[\"']?([^\s\"',;&<>]{4,}+)")
_KEY = re.compile(r"[^\W\d_][\w.-]*\Z")
_SPOKEN = re.compile(r"\b(password|passwd|passphrase|passcode|pin|pwd|token|secret|key)\s{1,3}(?:is|was)\s{1,3}[\"']?([^\s\"',;&<>]{4,}+)", re.IGNORECASE)
_RUN = re.compile(r"(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+.-]{8,}+={0,2}")
_LONG_RUN = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}")
_NUMBERS = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[0-9().-]|\x20(?=[0-9(]))*+(?![A-Za-z])")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])")
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|(?<=\x20)at(?=\x20))\x20?", re.IGNORECASE)
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|(?<=\x20)dot(?=\x20))\x20?[A-Za-z0-9-]++)+", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
_BLOCK_END = re.compile(r"-----END [A-Z0-9 ]*-----")
_BLOCK_BODY = re.compile(r"[A-Za-z0-9+/=\s]*+")
#: Words before secrets, contacts, identifiers, and before what is none of them.
_WORDS = (
    frozenset("password passwd passphrase passcode pass pwd secret token key apikey auth bearer credential credentials pin private".split()),
    frozenset("tel telephone phone mobile cell fax call whatsapp email mail contact reach".split()),
    frozenset("ssn iban passport account acct licence license social security tax insurance".split()),
    frozenset("commit sha sha1 sha256 md5 checksum hash version ver date isbn issn doi page pages year price order total time build revision ref figure table chapter section line http https url".split()),
)
_DOMAINS = frozenset("com org net edu gov io dev info biz de fr es it uk eu ch at nl pl se".split())
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\Z")
_HEX = re.compile(r"[0-9a-f]{16,}\Z|[0-9A-F]{16,}\Z")
_NUMBER = re.compile(r"[0-9().\x20-]+\Z")
_DATE = re.compile(r"(?:1[0-9]|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}\Z|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:[0-9]{2}|[0-9]{4})\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|(?:(?![A-Za-z])[^\W\d_])+")
_BEFORE = re.compile(r"[^\W\d_]+")

FORMAT = ("length", "digits", "upper", "lower", "other", "groups", "longest_digits", "switches", "case_switches", "entropy", "distinct", "hex", "luhn", "iban", "ssn", "dots", "slashes", "vowels", "longest_lower", "n_digits", "number", "spelt", "date", "opening")
CONTEXT = ("separator", "secret_word", "contact_word", "identifier_word", "other_word", "word_odds", "quoted", "before", "after", "near_base")


@dataclass(frozen=True)
class Candidate:
    """``by_format`` and ``by_context`` are the labels that one view gives to train the other: 1, 0, or -1 where nothing tells."""

    kind: str
    start: int
    end: int
    format: tuple[float, ...]
    context: tuple[float, ...]
    words: tuple[str, ...]
    by_format: int
    by_context: int
    proven: bool

    @property
    def names_other(self) -> bool:
        """A word before it names something that is not personal."""
        return not self.proven and self.context[CONTEXT.index("other_word")] > 0


def _iban_valid(s: str) -> bool:
    return bool(_IBAN.match(s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _char_class(c: str) -> int:
    return 0 if c.isspace() or not c else 1 if c.isalnum() else 2 if c in "\"'" else 3 if c == "+" else 4


def _keyed(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, key, separator) of values after a key. A value that holds keys itself gives the values of these too."""
    at = 0
    while m := _KEYED.search(text, at):
        start, end = m.span(3)
        at, value, key = end, m[3], m[1]
        separator = 1 if m[2] in ":\uFF1A" else 2
        if not (separator == 1 and value.startswith("//")):
            yield start, end, key, separator
        if "=" in value or ":" in value:
            begin, inner = start, ""
            for part in re.finditer(r"[=:]++", value):
                if inner and part.start() + start - begin >= 4:
                    yield begin, start + part.start(), inner, 2
                named = _KEY.search(value, max(begin - start, part.start() - 64), part.start())
                inner, begin = (named.group() if named else ""), start + part.end()
            if begin == end and inner:  # the value of the last key stands after a blank
                at = end - len(value) + part.start() - len(inner)
            elif inner and end - begin >= 4:
                yield begin, end, inner, 2


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    least = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (domain := _SPELT_DOMAIN.match(text, m.end())):
            least = domain.end()
            yield start, domain.end()


def proposals(text: str) -> dict[tuple[int, int], tuple[str, str, int, bool]]:
    """(start, end) to (generator, key, separator, proven) of everything that could be personal; spans overlap."""
    found: dict[tuple[int, int], tuple[str, str, int, bool]] = {}

    def add(start: int, end: int, how: str, key: str = "", separator: int = 0, proven: bool = False, trim: str = ".:!?)]}-") -> None:
        while trim and end > start and text[end - 1] in trim:
            end -= 1
        if end - start >= 4 and not ((start, end) in found and not proven):
            found[start, end] = (how, key, separator, proven)

    if "=" in text or ":" in text or "\uFF1A" in text:
        for start, end, key, separator in _keyed(text):
            if number := _NUMBERS.match(text, start):  # a number may go on after a blank
                end = max(end, start + len(number.group().rstrip(" ().-")))
            add(start, end, "value", key, separator)
    lower = text.lower() if " is " in text or " was " in text else ""
    if any(w in lower for w in ("pass", "pin", "pwd", "token", "secret", "key")):
        for m in _SPOKEN.finditer(text):
            add(*m.span(2), "value", m[1], 3)
    for m in _LONG_RUN.finditer(text):
        s = m.group()
        if sum(x.islower() and y.isupper() for x, y in zip(s, s[1:])) >= 3:
            add(*m.span(), "value")
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            s = m.group()
            if _DIGIT.search(s) and any(c.isalpha() for c in s):
                add(*m.span(), "value", trim=".-=/")
        for m in _NUMBERS.finditer(text):
            end = m.start() + len(m.group().rstrip(" ().-"))
            if end - m.start() >= 6:
                add(m.start(), end, "number", trim="")
        for m in _ACCOUNT.finditer(text):
            s = m.group()
            while " " in s and not _iban_valid(s.replace(" ", "")):  # a word in capitals may follow
                s = s[: s.rindex(" ")]
            if _iban_valid(s.replace(" ", "")):
                add(m.start(), m.start() + len(s), "identifier", proven=True)
    if _PREFIX.search(text):
        for m in _PREFIXED.finditer(text):
            add(*m.span(), "value", proven=True)
    if "dot" in text or "DOT" in text or "Dot" in text:
        for start, end in _spelt(text):
            add(start, end, "spelt", proven=_LABEL.findall(text[start:end])[-1].lower() in _DOMAINS, trim="-")
    if "-----BEGIN " in text:
        for m in _BLOCK.finditer(text):
            stop = _BLOCK_BODY.match(text, m.end()).end()
            end = _BLOCK_END.match(text, stop)
            add(m.start(), end.end() if end else m.end() + len(text[m.end() : stop].rstrip()), "value", proven=True, trim="")
    return found


def _format(s: str, how: str) -> tuple[tuple[float, ...], int]:
    """Features of a value alone, and what they tell: 1 where it looks drawn at random, 0 where it is plain."""
    n, counts = len(s), Counter(s)
    digits = sum(k for c, k in counts.items() if c in "0123456789")
    upper, lower = (sum(k for c, k in counts.items() if test(c)) for test in (str.isupper, str.islower))
    letters = sum(k for c, k in counts.items() if c.isalpha())
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    runs = re.findall(r"[0-9]+", s)
    classes = ["d" if c in "0123456789" else "a" if c.isalpha() else "o" for c in s]
    switches = sum(x != y for x, y in zip(classes, classes[1:]))
    case_switches = sum(x.islower() != y.islower() for x, y in zip(s, s[1:]) if x.isalpha() and y.isalpha())
    number, date = bool(_NUMBER.match(s)), bool(_DATE.match(s))
    is_hex, ssn = bool(_HEX.match(s)), bool(_SSN.match(s))
    card = 12 <= digits <= 19 and luhn("".join(c for c in s if c in "0123456789"))
    opening = 0 if s[0].isalnum() else 1 if s.startswith("//") else 2
    features = (
        min(n, 96), digits / n, upper / n, lower / n, (n - digits - letters) / n, min(len(runs), 40), max(map(len, runs), default=0), switches / n, case_switches / n, entropy, len(counts) / n, is_hex, card,
        _iban_valid(s) if n <= 34 else False, ssn, min(s.count("."), 20), min(s.count("/"), 20), sum(k for c, k in counts.items() if c in "aeiouAEIOU") / max(1, letters),
        max(map(len, re.findall(r"[a-z]+", s)), default=0), min(digits, 40), number, how == "spelt", date, opening,
    )
    if number:
        plain = digits < 7 or date or digits > 15
        return tuple(map(float, features)), 0 if plain else -1
    mixed = (digits and letters and switches >= 3) or case_switches >= 4
    if opening != 1 and s.count("/") < 3 and entropy > 3 and ((is_hex and digits and letters) or (n >= 14 and mixed)):
        return tuple(map(float, features)), 1
    plain = letters >= n - 1 and (lower == letters or upper == letters or (upper == 1 and s[0].isupper()))
    return tuple(map(float, features)), 0 if plain or opening == 1 or (not letters and digits < 7) else -1


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Overlapping candidates that no base span covers, with the features of both views and the label that each gives."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    for (a, b), (how, key, separator, proven) in sorted(proposals(text).items()):
        near = bisect_right(taken, (a, math.inf))
        if (near and taken[near - 1][1] > a) or (near < len(taken) and taken[near][0] < b):
            continue
        s = text[a:b]
        form, by_format = _format(s, how)
        number = bool(form[FORMAT.index("number")])
        # the words of the key, and before; white space and signs between them and the value don't matter
        before = [w.lower() for w in _BEFORE.findall(text[max(0, a - 40) : a])]
        own = [w.lower() for w in _PARTS.findall(key)] or before[-2:]
        groups = [any(w in known for w in own) for known in _WORDS]
        close = (near and a - taken[near - 1][1] < 60) or (near < len(taken) and taken[near][0] - b < 60)
        context = (float(separator), *map(float, groups), 0.0, float(text[a - 1 : a] in ("'", '"') if a else 0), float(_char_class(text[a - 1 : a] if a else "")), float(_char_class(text[b : b + 1])), float(bool(close)))
        code = number and groups[0] and separator > 0
        kind = "secret" if code else "identifier" if how == "identifier" or (number and (groups[2] or form[FORMAT.index("ssn")])) else "contact" if number or how == "spelt" else "secret"
        wanted = groups[0] if kind == "secret" else groups[1] or groups[2]
        anything = by_format == 0 and separator != 2 and not code  # a plain word, a date or a few digits after such a word
        by_context = (-1 if anything else 1) if wanted and not groups[3] else 0 if groups[3] or (not any(groups) and separator == 0) else -1
        out.append(Candidate(kind, a, b, form, context, tuple(dict.fromkeys(own[-2:])), 1 if proven else by_format, by_context, proven))
    return out


@dataclass
class PiiModel:
    """Trees over the format and over the context with the log-odds of words, and a threshold for each kind."""

    format: FlatTrees
    context: FlatTrees
    words: dict[str, float] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def odds(self, found: list[Candidate]) -> np.ndarray:
        """The sum of both margins of each candidate."""
        form, context = np.array([c.format for c in found]), np.array([c.context for c in found])
        context[:, CONTEXT.index("word_odds")] = [self.word_odds(c.words) for c in found]
        return self.format.margin(form) + self.context.margin(context)

    def word_odds(self, words: Iterable[str]) -> float:
        return max((self.words.get(w, 0.0) for w in words), key=abs, default=0.0)


def prior_texts() -> list[str]:
    """Short texts that the lists of words make: random values, numbers and plain words after each word, drawn by its hash."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def drawn(seed: str, n: int, signs: str) -> str:
        stream = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(n // 32 + 1))
        return "".join(signs[b % len(signs)] for b in stream[:n])

    out = []
    for group, words in enumerate(_WORDS):
        for word in sorted(words):
            for i in range(PRIOR_DRAWS):
                seed, sign = f"{word}/{i}", (" = ", ": ", "=", " ")[i % 4]
                value = drawn(seed, (20, 16, 32, 40)[i % 4], "0123456789abcdef" if i == 3 else letters)
                number = f"0{drawn(seed, 3, '123456789')} {drawn(seed + 'n', 7, '0123456789')}"
                if group == 0:
                    out += [f"{word}{sign.strip() and sign or ': '}{value}", f"{word} = {drawn(seed, 9, letters[26:52])}"]
                elif group == 1:
                    out += [f"{word}{sign}{number}", f"{word}: {number.replace(' ', '-')}"]
                elif group == 2:
                    out += [f"{word}{sign}{drawn(seed, 9, '123456789')}", f"{word} 2{drawn(seed, 2, '123456789')}-{drawn(seed, 2, '123456789')}-{drawn(seed, 4, '123456789')}"]
                else:
                    out += [f"{word}{sign}{value}", f"{word}: {drawn(seed, 4, '123456789')}", f"{word} {drawn(seed, 10, '123456789')}"]
    plain = sorted(_WORDS[3])
    out += [f"and {w}: {w}{w}" for w in plain] + [f"in 19{i:02d} and {i}.{i}.{i}, then {i + 1}0{i:02d}.50 of them" for i in range(10, 50)]
    return out


def prior_candidates() -> list[Candidate]:
    """The labelled candidates of ``prior_texts``."""
    found = [c for t in prior_texts() for c in candidates(t, base_spans(t))]
    return [c for c in found if max(c.by_format, c.by_context) >= 0]


def is_negative(c: Candidate) -> bool:
    """What a threshold is read from: one view says no and the other doesn't say yes, or a word names something else."""
    return c.names_other or 0 in (c.by_format, c.by_context) and 1 not in (c.by_format, c.by_context)


def calibrate(docs: DataFrame, model: PiiModel, prior: list[Candidate] | None = None) -> dict[str, float]:
    """For each kind the summed margin that no more than 1 in 200 labelled negatives of all texts and of ``prior`` exceed.

    A kind without any labelled negative takes the threshold of all kinds together, and that is the least
    threshold where there is none at all.
    """

    def count(found: list[Candidate], counts: np.ndarray, by: PiiModel) -> None:
        for i in range(0, len(found), 20_000):
            part = found[i : i + 20_000]
            bins = np.clip((by.odds(part) + ODDS) * (BINS / (2 * ODDS)), 0, BINS - 1).astype(np.int64)
            np.add.at(counts, ([ADDED_KINDS.index(c.kind) for c in part], bins), 1)

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ADDED_KINDS), BINS), dtype=np.int64)
        for batch in batches:
            count([c for t in batch.column("text").to_pylist() if t for c in candidates(t, base_spans(t)) if is_negative(c)], counts, shared.value)
        kind, place = np.nonzero(counts)
        yield record_batch([("kind", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())], kind=kind.astype(np.int32), bin=place.astype(np.int32), n=counts[kind, place])

    table = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(score, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(ADDED_KINDS), BINS), dtype=np.int64)
    counts[table.column("kind").to_numpy(), table.column("bin").to_numpy()] = table.column("n").to_numpy()
    count([c for c in prior or () if is_negative(c)], counts, model)

    def edge(own: np.ndarray) -> float:
        place = int(np.searchsorted(200 * np.cumsum(own), 199 * own.sum()))
        return math.inf if place == BINS - 1 else (place + 1) * (2 * ODDS / BINS) - ODDS

    pooled = counts.sum(axis=0)
    if not pooled.any():
        return dict.fromkeys(ADDED_KINDS, LEAST_ODDS)
    return {kind: max(LEAST_ODDS, edge(own if own.any() else pooled)) for kind, own in zip(ADDED_KINDS, counts)}


def fit_views(found: list[Candidate]) -> PiiModel:
    """Trees of both views, each trained on the labels of the other, and the log-odds of words."""
    by_format, by_context = np.array([c.by_format for c in found]), np.array([c.by_context for c in found])
    # the log-odds of each word, from the labels of formats; a candidate's own label is left out of what it sees
    told = (by_format >= 0) | np.array([c.names_other for c in found], dtype=bool)
    told &= ~((by_format == 0) & (by_context == 1))
    # a check sum looks as random as a secret: after a word that names something else it is none, whatever its format
    by_format = np.where([c.names_other for c in found], 0, by_format)
    n = {y: Counter(w for c, t, f in zip(found, told, by_format) if t and f == y for w in c.words) for y in (0, 1)}
    total = [max(1, int((told & (by_format == y)).sum())) for y in (0, 1)]

    def odds(w: str, own: int | None = None) -> float:
        no, yes = n[0][w] - (own == 0), n[1][w] - (own == 1)
        return math.log((yes + 0.5) / (total[1] + 1)) - math.log((no + 0.5) / (total[0] + 1)) if no + yes >= LEAST_WORD else 0.0

    context = np.array([c.context for c in found]).reshape(-1, len(CONTEXT))
    context[:, CONTEXT.index("word_odds")] = [max((odds(w, f if t else None) for w in c.words), key=abs, default=0.0) for c, t, f in zip(found, told, by_format)]
    form = np.array([c.format for c in found]).reshape(-1, len(FORMAT))
    taught = (by_context >= 0) & ~((by_context == 0) & np.array([c.by_format == 1 for c in found], dtype=bool))
    views = []
    for x, y, use in ((form, by_context, taught), (context, by_format, told)):
        views.append(fit(x[use], y[use].astype(float), trees=40, depth=4, least=5))
    return PiiModel(*views, {w: odds(w) for w in n[0].keys() | n[1].keys() if n[0][w] + n[1][w] >= LEAST_WORD})


_SAMPLE = [("u", pa.int64()), ("kind", pa.string()), ("by_format", pa.int32()), ("by_context", pa.int32()), ("format", pa.list_(pa.float64())), ("context", pa.list_(pa.float64())), ("words", pa.list_(pa.string()))]


def train(docs: DataFrame, texts: int = TRAINING_TEXTS, most: int = TRAINING_CANDIDATES) -> PiiModel:
    """Trees from candidates of at most ``texts`` texts with a digit, ``@``, ``=`` or ``:``, by the hash of their ids,
    at most ``most`` that some view calls personal and as many others; thresholds from all texts."""
    bound_batches(docs.sparkSession)
    likely = docs.where(F.col("text").rlike("[0-9@=:]")).select(F.col("text").cast("string").alias("text"), hash_unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed=10).alias("u"))
    share = min(1.0, texts / max(1, likely.count()))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies say no more than one of them
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                for c in candidates(t, base_spans(t)):
                    u = zlib.crc32(f"{c.kind}{c.start}{t[max(0, c.start - 40) : c.end]}".encode("utf-8", "surrogatepass"))
                    if max(c.by_format, c.by_context) >= 0 and u not in seen:
                        rows.append((u, c))
                        if len(seen) < 500_000:
                            seen.add(u)
            for i in range(0, len(rows), 5000):
                part = rows[i : i + 5000]
                columns = {name: [getattr(c, name) for _, c in part] for name, _ in _SAMPLE[1:]}
                yield record_batch(_SAMPLE, u=[u for u, _ in part], **columns)

    ddl = "u long, kind string, by_format int, by_context int, format array<double>, context array<double>, words array<string>"
    proposed = materialize(likely.where(F.col("u") < share).select("text").mapInArrow(propose, ddl), "pii-sample")
    yes = F.greatest("by_format", "by_context") == 1
    tables = [proposed.where(test).orderBy("u").limit(most).toArrow() for test in (yes, ~yes)]
    rows = {r["u"]: r for t in tables for r in t.to_pylist()}
    found = [Candidate(r["kind"], 0, 0, tuple(r["format"]), tuple(r["context"]), tuple(r["words"]), r["by_format"], r["by_context"], False) for _, r in sorted(rows.items())]
    prior = prior_candidates()
    model = fit_views(found + prior)
    model.thresholds = calibrate(docs, model, prior)
    return model


def added_spans(text: str, base: list[Span], model: PiiModel) -> list[Span]:
    """What is added to the base spans of a text, by kind and start: what is proven, then what the trees are surest of, none overlapping."""
    proposed = candidates(text, base)
    if not proposed:
        return []
    odds = [math.inf if c.proven else o for c, o in zip(proposed, model.odds(proposed).tolist())]
    taken = sorted((a, b) for _, a, b in base)
    chosen = []
    for i in sorted(range(len(proposed)), key=lambda i: (-odds[i], proposed[i].start, -proposed[i].end)):
        c = proposed[i]
        if not c.proven and odds[i] <= model.thresholds.get(c.kind, LEAST_ODDS):
            continue
        at = bisect_right(taken, (c.start, math.inf))
        if (at and taken[at - 1][1] > c.start) or (at < len(taken) and taken[at][0] < c.end):
            continue
        taken.insert(at, (c.start, c.end))
        chosen.append((c.kind, c.start, c.end))
    return sorted(chosen, key=lambda s: (ADDED_KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    out, cursor = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= cursor:
            out += [text[cursor:a], f"[{kind.upper()}]"]
            cursor = b
    return "".join([*out, text[cursor:]])


_OUT = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), *((f"n_{k}", pa.int64()) for k in ADDED_KINDS)]


def find(docs: DataFrame, model: PiiModel, redacted: bool = False) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans (base, then added), n_spans, the number of
    added spans of each kind and, if wanted, the redacted text.

    Offsets are code points of the whole text; null text is empty and has no spans. Ids may be null
    or repeated; an empty table gives an empty one; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = _OUT + [("redacted", pa.string())] * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns: dict[str, list] = {name: [] for name, _ in fields if name != "doc_id"}
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base + added_spans(text, base, shared.value)
                n = Counter(k for k, _, _ in spans)
                columns["n_spans"].append(len(spans))
                for kind in BASE_KINDS + ADDED_KINDS:
                    columns[f"n_{kind}"].append(n[kind])
                columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns["spans"].append(joined(spans))
                if redacted:
                    columns["redacted"].append(redact(text, spans))
            yield record_batch(fields, doc_id=batch.column("doc_id"), **columns)

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_spans long, " + ", ".join(f"n_{k} long" for k in ADDED_KINDS) + ", redacted string" * redacted
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    return find(docs, train(docs, **options))
