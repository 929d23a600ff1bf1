"""Personal data: exact patterns and a linear-chain conditional random field.

Patterns give the base spans. The random field labels tokens around digits and @ signs
from their shapes (kind and length of a token, how it is joined to its neighbours) and the
words beside them; it is trained by gradient on a small labelled table, LABELLED below,
written by hand and so independent of the patterns: half of its spans are in forms that no
pattern takes (phones without a plus sign, two cards in a row, addresses with spaces), and
its rows without braces are numbers that are nobody's. Decoding is Viterbi, many windows at
once in numpy. What the field finds clear of the base spans is added if it passes its
kind's check and no digit or letter borders it; base spans always stay.

A window is cut only between tokens: WINDOW tokens at most, of which EDGE on either side
are decoded again with the next window and count there. Batches are bounded in tokens,
padding included, so a text of any length or kind takes memory in proportion to itself.

Defined results: null and empty texts have no spans; ids may be null or repeat; offsets
are code points, ends exclusive; an empty table gives no rows; redact carries other
columns untouched and null texts stay null.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, mixed, read_documents, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A digit run that fails from its first digit fails from every other: no retries inside it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def octet(part: str) -> bool:
    return len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_card(s: str) -> bool:
    return 12 <= len(d := _digits(s)) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# The labelled table -----------------------------------------------------------------------

#: Sentences with personal data in braces, kind first. Digits stand for any.
LABELLED = """
call me at {phone:(555) 201-3344} after six
her number is {phone:555-201-3344} and she is in
tel {phone:555 201 3344} or come by
phone: {phone:020 7946 0958}, ask for the desk
mobile {phone:07700 900123} at night
you can reach us on {phone:1-800-555-0199} all day
fax {phone:(0221) 4710-9987} in the hall
Telefon {phone:030 901820 44}, bitte nur morgens
Tel.: {phone:0171 2345678} am Abend
rufen Sie {phone:(089) 2180-4321} an
appelez le {phone:01 42 68 53 00} avant midi
son portable est le {phone:06 12 34 56 78}.
llame al {phone:91 555 23 45 67} por la tarde
mi teléfono es {phone:(34) 600-123-456} y no otro
contact {phone:+1 (555) 201-3344} for help
the line {phone:+44 20 7946 0958} is open
Was {phone:+1 (921) 555-0144} on the door, the
und {phone:+49 30 901820} im Büro
ou {phone:+33 1 42 68 53 00} le soir
con {phone:+34 600 123 456} siempre
call {phone:(555) 201-3344} or {phone:(555) 201-9876} now
numbers: {phone:555-201-3344}, {phone:555-201-9876}
card {card:4111111111111111} was charged
paid by {card:4111 1111 1111 1111} on the day
visa {card:5500-0000-0000-0004} ends soon
cards {card:4111111111111111} {card:5500000000000004} were lost
both {card:4111111111111111} {card:5500000000000004} and
use {card:4111111111111111}-{card:5500000000000004} here
from {card:371449635398431} to {card:6011111111111117} moved
the {card:4111111111111111} thanging the and
eher {card:5500000000000004} erlich und
Karte {card:4111.1111.1111.1111} ist weg
número {card:4111.1111.1111.1111} de la tarjeta
carte {card:4539 5787 6362 1486} perdue
{card:4111111111111111}$$$ thlywhing
card no. {card:4012888888881881}, name on it
server {ip:192.168.10.24} is down
from {ip:10.0.0.7} to {ip:10.0.0.8} in order
the {ip:141.73.119.60} thinth
host {ip:83.229.25.121} esat ha
und {ip:230.40.1.146} der
ip={ip:172.16.254.1};
addresses {ip:10.1.2.3},{ip:10.1.2.4} seen
ping {ip:8.8.8.8}: no answer
que {ip:196.251.51.155} y de
mail {email:jan.de@example.org} today
to.{email:anna_b@mail.example.com} and
her address {email:kim+news@uni.example.edu}, she said
write to {email:jan @ example.org} please
send it to {email:anna @ mail.example.com}, thanks
an {email:kai @ beispiel.de} schreiben
écrivez à {email:luc @ exemple.fr} vite
escriba a {email:eva @ ejemplo.es} hoy
mail {email:jan (at) example.org} today
ask {email:anna (at) mail.example.com} first
{email:kim [at] example.net} has it
was.{email:ti@mail4.example.com} to the
und {email:be.36@mail5.example.com} über
in 1999 there were 24 of them
the year 2021-03-04 at 10:15:30 it rang
on 2021-03-04 and 2021-03-05 we met
am 04.03.2021 um 10.15 Uhr
le 04/03/2021 à 10 heures
el 4 de marzo de 2021 fue
version 3.11.4 of the tool
released 2.0.1, then 2.0.2 and 2.1.0
section 4.3.2.1 on page 17
chapters 1 2 3 4 5 6 7 8 9 10 11 12
scores 12 14 9 30 22 17 8 41 12 11
it cost 1 299.00 or 1,299.00 in all
about 3 000 000 people in 12 000 towns
ISBN 978-3-16-148410-0 is out
order 978-0-306-40615-7 arrived late
part no. 4471-2298-0091 in stock
the id 4881297747170635 was new
row 1142126282388588 of the table
key 8466396249332160 is not there
a hash 592e2677e7e6567f917b8bfcceb4e5730d6fd3bc here
token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa" der
token = "7f5790b897549d620aedfc0705a565f96e3741e8" und
uuid 123e4567-e89b-12d3-a456-426614174000 made
commit 9f86d081884c7d65 on the branch
Licensed under CC BY-NC 4.0.
GNU General Public License, version 3.
Apache License, Version 2.0.
follow @kim and @jan for more
@all please read this
rooms 101-110 and 201-210 are full
from 1914-1918 and 1939-1945 there was war
ratio 16:9 at 1920x1080 and 60 Hz
grades 1.0 2.0 3.5 and 4.25
pi is 3.14159265358979 or so
tracking 1Z 999 AA1 01 2345 6784 shipped
zip 90210-1234 and 10115 are codes
lottery 4 8 15 16 23 42 again
temperatures -12 -8 -3 0 4 9 14
table 12 | 14 | 16 | 18 | 20
200 000 000 000 stars
bytes 00 1f 8b 08 00 00 00 00
line 1024 1024 1024 1024 of the log
""".strip().split("\n")
MARKED = re.compile(r"\{(email|ip|card|phone):([^{}]*)\}")


def marked_row(row: str) -> tuple[str, list[Span]]:
    """A row's text without its braces, and the spans they mark."""
    text, spans, at = "", [], 0
    for m in MARKED.finditer(row):
        text += row[at : m.start()]
        spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + row[at:], spans


# Tokens and their features --------------------------------------------------------------

TRIGGER = re.compile(r"[0-9]+|@+|[(\[]at[)\]]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|([^\w\s])\1*|_+")
REACH, WINDOW, EDGE = 24, 256, 32
N_FEATURES = 1 << 14


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @ signs, REACH code points to either side."""
    a = b = -1
    for m in TRIGGER.finditer(text):
        if m.start() - REACH > b:
            if b >= 0:
                yield a, b
            a = max(0, m.start() - REACH)
        b = min(len(text), m.end() + REACH)
    if b >= 0:
        yield a, b


@lru_cache(1 << 14)
def _marks(token: str, long: int) -> tuple[int, int]:
    """Numbers of a token's shape and of the word it is."""
    c = token[0]
    if "0" <= c <= "9":
        shape = f"d{min(long, 20)}"
    elif c.isalpha():
        shape = ("A" if c.isupper() else "a") + str(min(long, 3))
    else:
        shape = c + "+" * (long > 1)
    return crc32(shape.encode()), crc32(token.lower().encode()) if c.isalpha() else crc32(shape.encode())


def _features(places: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """(tokens, templates): numbers of each token's features."""
    n = len(places)
    shape, word = (np.concatenate([[1, 1], marks[:, k], [2, 2]]).astype(np.uint64) for k in (0, 1))
    glued = np.zeros(n + 1, np.uint64)
    glued[1:n] = places[1:, 0] == places[:-1, 1]
    g = glued[:-1] + np.uint64(2) * glued[1:]
    s = lambda k: shape[2 + k : 2 + k + n]
    w = lambda k: word[2 + k : 2 + k + n]
    templates = ((s(0),), (s(0), g), (s(-1), s(0), g), (s(0), s(1), g), (s(-2), s(-1), s(0)), (s(0), s(1), s(2)), (s(-1), s(1), g), (w(-1), s(0)), (w(-2), s(0)), (w(1), s(0)), (s(-2), s(-1), s(0), s(1), s(2), g))
    out = np.empty((n, len(templates)), np.int64)
    for k, parts in enumerate(templates):
        h = np.full(n, k + 1, np.uint64)
        for part in parts:
            h = mixed(h * np.uint64(0x9DDFEA08EB382D69) + part)
        out[:, k] = (h % np.uint64(N_FEATURES)).astype(np.int64)
    return out


def windows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool]]:
    """For each window: its tokens' places and features, which tokens count in it (from, to),
    and whether it goes on where the one before ended."""

    def window(lo: int, hi: int, goes_on: bool) -> tuple:
        at = np.array(places)
        return at, _features(at, np.array(marks, np.uint64)), lo, hi, goes_on

    for a, b in stretches(text):
        places, marks, goes_on = [], [], False
        for m in TOKEN.finditer(text, a, b):
            if len(places) == WINDOW:
                yield window(EDGE if goes_on else 0, WINDOW - EDGE, goes_on)
                places, marks, goes_on = places[-2 * EDGE :], marks[-2 * EDGE :], True
            places.append(m.span())
            marks.append(_marks(text[m.start() : min(m.end(), m.start() + 24)], m.end() - m.start()))
        if places:
            yield window(EDGE if goes_on else 0, len(places), goes_on)


def labels_of(places: np.ndarray, spans: list[Span]) -> np.ndarray:
    out, last = np.zeros(len(places), np.int64), None
    for k, (x, y) in enumerate(places.tolist()):
        span = next((s for s in spans if s[0] <= x and y <= s[2]), None)
        out[k] = 0 if span is None else 1 + 2 * span[1] + (span == last)
        last = span
    return out


@dataclass
class Field:
    """Weights of (feature, label) and of (label before, label)."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each window; at most CELLS tokens, padded, at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(feats)
        by_size = np.argsort([len(f) for f in feats], kind="stable")
        while len(by_size):
            longest = len(feats[by_size[-1]])
            some, by_size = by_size[-max(1, CELLS // longest) :], by_size[: -max(1, CELLS // longest)]
            scores, mask = _padded([feats[k] for k in some], self.emit)
            n = len(some)
            best, back = scores[:, 0], np.zeros(scores.shape, np.int8)
            for t in range(1, longest):
                path = best[:, :, None] + self.move
                back[:, t] = path.argmax(axis=1)
                best = np.where(mask[:, t, None], path.max(axis=1) + scores[:, t], best)
                back[~mask[:, t], t] = np.arange(len(LABELS))
            path = np.zeros((n, longest), np.int64)
            path[:, -1] = best.argmax(axis=1)
            for t in range(longest - 1, 0, -1):
                path[:, t - 1] = back[np.arange(n), t, path[:, t]]
            for r, k in enumerate(some):
                out[k] = path[r, : len(feats[k])]
        return out


CELLS = 1 << 15


def _padded(feats: list[np.ndarray], emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, longest = len(feats), max(map(len, feats))
    scores, mask = np.zeros((n, longest, len(LABELS))), np.zeros((n, longest), bool)
    for k, f in enumerate(feats):
        scores[k, : len(f)] = emit[f].sum(axis=1)
        mask[k, : len(f)] = True
    return scores, mask


def train(feats: list[np.ndarray], labels: list[np.ndarray], steps: int = 60, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam, all windows in step."""
    size, n = len(LABELS), len(feats)
    longest = max(map(len, feats))
    gold = np.zeros((n, longest), np.int64)
    for k, own in enumerate(labels):
        gold[k, : len(own)] = own
    ids = np.concatenate(feats)
    at = np.zeros((N_FEATURES + size, size))
    first, second = np.zeros_like(at), np.zeros_like(at)
    log_sum = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
    for step in range(1, steps + 1):
        emit, move = at[:N_FEATURES], at[N_FEATURES:]
        scores, mask = _padded(feats, emit)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], log_sum(ahead[:, t - 1][:, :, None] + move, 1) + scores[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], log_sum(move + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0.0)
        total = log_sum(ahead[:, -1], 1)
        here = np.exp(ahead + behind - total[:, None, None])
        here[np.arange(n)[:, None], np.arange(longest), gold] -= 1
        g = np.zeros_like(at)
        flat = here[mask]
        for c in range(size):
            g[:N_FEATURES, c] = np.bincount(ids.reshape(-1), np.repeat(flat[:, c], ids.shape[1]), N_FEATURES)
        for t in range(1, longest):
            k = mask[:, t]
            both = np.exp(ahead[k, t - 1][:, :, None] + move + (scores[k, t] + behind[k, t])[:, None, :] - total[k][:, None, None])
            g[N_FEATURES:] += both.sum(axis=0)
            np.add.at(g[N_FEATURES:], (gold[k, t - 1], gold[k, t]), -1)
        g = g / n + ridge * at
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        at = at - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(at[:N_FEATURES].copy(), at[N_FEATURES:].copy())


def varied(rows: tuple[str, ...], table: tuple[str, ...], times: int) -> list[str]:
    """rows, and each of them `times` more with its spans in other forms of their kind,
    taken in turn from the table."""
    forms = {k: sorted({m[2] for r in table for m in MARKED.finditer(r) if m[1] == k}) for k in KINDS}
    other = lambda m, at: f"{{{m[1]}:{forms[m[1]][at % len(forms[m[1]])]}}}"
    return [*rows, *(MARKED.sub(lambda m: other(m, 7 * t + k), r) for t in range(1, times + 1) for k, r in enumerate(rows) if MARKED.search(r))]  # noqa: B023


def labelled_windows(rows: Iterable[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and labels of the windows of marked rows."""
    feats, labels = [], []
    for row in rows:
        text, spans = marked_row(row)
        for places, f, *_ in windows(text):
            feats.append(f)
            labels.append(labels_of(places, spans))
    return feats, labels


@lru_cache(4)
def fit(rows: tuple[str, ...] = tuple(LABELLED), table: tuple[str, ...] = tuple(LABELLED), times: int = 4) -> Field:
    """A field from a small labelled table of marked rows, each also with other forms of the
    table; the driver holds no other data."""
    return train(*labelled_windows(varied(rows, table, times)))


ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHECKS = (
    lambda s: bool(ADDRESS.fullmatch(s)),
    lambda s: len(p := s.split(".")) == 4 and all(x.isascii() and x.isdigit() and octet(x) for x in p),
    lambda s: bool(re.fullmatch(r"[0-9][0-9 .-]*[0-9]", s)) and is_card(s),
    lambda s: 10 <= len(_digits(s)) <= 15 and bool(re.fullmatch(r"\+?[(0-9][\x20().0-9-]+[0-9]", s)) and any(c in " -(" for c in s),
)


def added_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field finds clear of the base spans, windows decoded CELLS tokens at a time."""
    found: list[list[list[int]]] = [[] for _ in texts]  # kind, begin, end, number of the last token
    held: list[tuple] = []
    size = number = 0

    def decode() -> None:
        nonlocal number
        for (k, places, _, lo, hi, goes_on), path in zip(held, field.viterbi([h[2] for h in held]), strict=True):
            number += not goes_on  # a gap between windows ends a span
            for t in np.flatnonzero(path[lo:hi]) + lo:
                label, here = int(path[t]), number + int(t) - lo
                kind, (x, y) = (label - 1) // 2, places[t].tolist()
                last = found[k][-1] if found[k] else None
                if label % 2 == 0 and last and last[0] == kind and last[3] == here - 1:
                    last[2], last[3] = y, here
                else:
                    found[k].append([kind, x, y, here])
            number += hi - lo
        held.clear()

    for k, text in enumerate(texts):
        for places, feats, lo, hi, goes_on in windows(text):
            held.append((k, places, feats, lo, hi, goes_on))
            size += len(places)
            if size >= CELLS:
                decode()
                size = 0
    if held:
        decode()
    out: list[list[Span]] = []
    for text, base, spans in zip(texts, bases, found, strict=True):
        starts = [s[0] for s in base]
        reach = list(accumulate((s[2] for s in base), max))
        clear = []
        for kind, a, b, _ in spans:
            before = bisect_left(starts, b)  # base spans that begin before the end
            bordered = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
            if not bordered and not (before and reach[before - 1] > a) and CHECKS[kind](text[a:b]):
                clear.append((a, kind, b))
        out.append(clear)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _both(batch: pa.RecordBatch, column: int, field: Field | None) -> Iterator[tuple[str, list[Span], list[Span]]]:
    texts_of = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts_of.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, 1 << 20):
        texts = [t or "" for t in texts_of.slice(a, b - a).to_pylist()]
        bases = [base_spans(t) for t in texts]
        more = added_spans(texts, bases, field) if field is not None else [[] for _ in texts]
        yield from zip(texts, bases, more, strict=True)


def find_private(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, base counts by kind, base and all spans as text, how many were added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, base, more in _both(batch, 1, field):
                counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base), _joined(sorted(base + more)), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", "spans", "n_added"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base_spans string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with every span replaced by its kind in brackets, n_chars (if there) with it."""
    names = docs.columns
    text, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for was, base, more in _both(batch, text, field):
                parts, at = [], 0
                for a, k, b in sorted(base + more):
                    if b > at:
                        parts += [was[at : max(a, at)], f"[{KINDS[k].upper()}]"]
                        at = b
                new.append("".join([*parts, was[at:]]))
            columns = list(batch.columns)
            missing = columns[text].is_null()
            columns[text] = pa.array([None if m else t for m, t in zip(missing.to_pylist(), new, strict=True)], pa.string())
            if count is not None:
                columns[count] = pa.array([n if m else len(t) for n, m, t in zip(columns[count].to_pylist(), missing.to_pylist(), new, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(names))])

    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(run, numbered(docs)).toDF(*names)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return find_private(docs, fit()).drop("base_spans")


QUERIES = {"op6_private_data": op6_private_data}
ORACLES: dict[str, str] = {}
