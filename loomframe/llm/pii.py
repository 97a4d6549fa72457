"""Personal data: exact patterns, and boosted trees over spans from high-recall generators.

Patterns (`email`, `ip`, `card`, `phone`) are found exactly.  Generators propose further, overlapping
spans: groups of digits with separators, addresses with spelled-out signs, account and social
security formats.  Boosted trees score them by format and context; their scores are calibrated by a
logistic curve on held-back candidates (one in four), and the least calibrated probability that
reached PRECISION there, one half at least, is the threshold; of overlapping ones the likeliest stays.
These are added as `other` where they touch no pattern's span.

The trees learn from at most TRAIN_TEXTS texts, those of smallest hash that can hold candidates (of each
the first TRAIN_SPANS candidates that teach anything), and the written EXAMPLES: pattern matches, accounts
and social security numbers that pass their checks, bracketed addresses, and telephone numbers behind
their cue are positive; what fails a check, and other candidates in texts without cues, is negative; the
rest teaches nothing.  These bounds hold for learning alone.  Scanning covers every candidate of every
text.

Cases: null and empty texts have no spans.  Tables without candidates learn from the examples.  Rows
are judged one by one, each text whole in one task; extra columns of any name stay, but for `pii`, which
is replaced.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import Texts, chunks, plain_names, ship, words

KINDS = ("email", "ip", "card", "phone", "other")
TRAIN_TEXTS = 1500
TRAIN_SPANS = 12
PRECISION = 0.98

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_GROUPS = re.compile(rb"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){5,24}")
_AT = re.compile(rb"(?i:at)\x20?[\])}]")
_SPELLED = re.compile(rb"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]?\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:[\[({]\x20?(?i:dot)\x20?[\])}]|\.)\x20?[A-Za-z0-9-]{1,24}){1,4}")
#: Most bytes of a spelled address before and after its `at`.
_SPELLED_BEFORE, _SPELLED_AFTER = 67, 220
_BRACKETED = re.compile(rb".*(?:\[\x20?(?i:at)\x20?\]|\(\x20?(?i:at)\x20?\)|\{\x20?(?i:at)\x20?\}).*[A-Za-z]{2}", re.S)
_SSN = re.compile(rb"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NATIONAL = re.compile(rb"\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}[\x20.-][0-9]{4}")
_PHONE_CUE = re.compile(rb"\b(?:phone|tel|telephone|call|mobile|fax)\b", re.I)
_ACCOUNT = re.compile(rb"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?")
_CUES = re.compile(rb"phone|tel|call|mobile|fax|mail|contact|card|visa|credit|account|iban|ssn|passport|address", re.I)


#: A text that can hold candidates, for Java's matcher.
_MAY_TEACH = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|[0-9](?:[\x20().-]{0,2}[0-9]){5}|(?i:at)\x20?[\])}]|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"


class Overlaps:
    """Spans of one row: do any touch another span?  Takes logarithmic time, however they overlap each other."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = np.maximum.accumulate([e for _, e in spans]).tolist() if spans else []
        self.more: list[tuple[int, int]] = []  # added later; these do not overlap

    def touch(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e) - 1
        if k >= 0 and self.ends[k] > s:
            return True
        k = bisect.bisect_left(self.more, (e, -1)) - 1
        return k >= 0 and self.more[k][1] > s

    def add(self, s: int, e: int) -> None:
        bisect.insort(self.more, (s, e))


def _by_row(spans: list[tuple[int, int, int]]) -> dict[int, Overlaps]:
    rows: dict[int, list[tuple[int, int]]] = {}
    for r, s, e in spans:
        rows.setdefault(r, []).append((s, e))
    return {r: Overlaps(x) for r, x in rows.items()}


def _flags(*members: int | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for m in members:
        out[list(m) if isinstance(m, range) else m] = True
    return out


_DIGIT = _flags(range(48, 58))
_ALNUM = (range(48, 58), range(65, 91), range(97, 123))
_IN_EMAIL = _flags(*_ALNUM, *b"._%+-@")
_IN_IP = _flags(range(48, 58), 46)
_IN_CARD = _flags(range(48, 58), 32, 45)
_IN_PHONE = _flags(range(48, 58), *b" ().-+")


#: Written examples (public specimens): texts of a few of these teach the formats that a table may lack.
EXAMPLES = [
    f"{lead}{span}{tail}"
    for span in (
        "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "BE68 5390 0754 7034", "DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606",
        "DE88 3704 0044 0532 0130 00", "GB28 WEST 1234 5698 7654 32", "NL19ABNA0417164300", "AB12 CDEF 1234 GHIJ 5678",
        "078-05-1120", "219-09-9999", "123-45-6789", "000-12-3456", "666-12-3456", "987-65-4321", "123-00-4567",
        "bob [at] site [dot] org", "bob [ at ] site [dot] org", "jane.doe(at)example.com", "info {At} example {dot} co {dot} uk", "a.b [AT] mail [DOT] example [DOT] net", "x-y ( at ) example . org",
        "look at) this.thing", "(415) 555-0100", "415-555-0100", "2024-01-02 10:20:30", "1000000 2000000", "3.14159265",
    )
    for lead, tail in (("", ""), ("see ", "."), ("IBAN: ", " thanks"), ("write to me: ", ", or later"), ("phone ", ";"))
]


def _iban(span: bytes) -> bool:
    plain = span.replace(b" ", b"")
    return 15 <= len(plain) <= 34 and int("".join(str(int(chr(c), 36)) for c in plain[4:] + plain[:4])) % 97 == 1 if _ACCOUNT.fullmatch(span) else False


def _ssn(span: bytes) -> bool:
    return span[:3] not in (b"000", b"666") and span[:1] != b"9" and span[4:6] != b"00" and span[7:] != b"0000"


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = (d - 48) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(span: bytes) -> bytes:
    return bytes(c for c in span if 48 <= c < 58)


def _valid(kind: int, m: re.Match) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))
    digits = _digits(m[0])
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def _emails(raw: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@` and a domain within one run of such bytes.

    Whether a match ends well depends on what follows its @ alone, so each @ is tried once: this takes
    linear time where a search from every byte of a long run would not.
    """
    low, at = start, raw.find(b"@", start, end)
    while at >= 0:
        domain = _DOMAIN.match(raw, at + 1, end) if at > low else None
        if domain:
            yield low, domain.end()
        low = domain.end() if domain else at + 1
        at = raw.find(b"@", low, end)


class Scan:
    """Pattern spans (row, kind, start, end) of a chunk of texts, in its bytes, and failed matches."""

    def __init__(self, texts: Texts):
        self.texts, self.raw = texts, texts.data.tobytes()
        self.spans: list[tuple[int, int, int, int]] = []
        self.failed: list[tuple[int, int, int, int]] = []
        digits = np.concatenate([[0], np.cumsum(_DIGIT[texts.data])])
        signs = {c: np.concatenate([[0], np.cumsum(texts.data == c)]) for c in (64, 46, 43)}
        # a match lies inside one run of the bytes that it may hold, so only runs that can hold one are searched
        for kind, (table, pattern, sign, least, n_digits) in enumerate(((_IN_EMAIL, None, 64, 1, 0), (_IN_IP, _IP, 46, 3, 4), (_IN_CARD, _CARD, None, 0, 13), (_IN_PHONE, _PHONE, 43, 1, 9))):
            start, end, _ = words(texts, table)
            ok = digits[end] - digits[start] >= n_digits
            if sign is not None:
                ok &= signs[sign][end] - signs[sign][start] >= least
            start, end = start[ok], end[ok]
            row = np.searchsorted(texts.offsets, start, "right") - 1
            for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
                if pattern is None:
                    self.spans += [(r, kind, *span) for span in _emails(self.raw, s, e)]
                    continue
                for m in pattern.finditer(self.raw, s, e):
                    (self.spans if _valid(kind, m) else self.failed).append((r, kind, m.start(), m.end()))
        self.digits = digits

    def candidates(self) -> list[tuple[int, int, int]]:
        """(row, start, end) of the generators' spans."""
        t, out = self.texts, []
        start, end, _ = words(t, _IN_PHONE)
        ok = self.digits[end] - self.digits[start] >= 6
        row = np.searchsorted(t.offsets, start, "right") - 1
        for r, s, e in zip(row[ok].tolist(), start[ok].tolist(), end[ok].tolist(), strict=True):
            out += [(r, *m.span()) for p in (_GROUPS, _SSN) for m in p.finditer(self.raw, s, e)]
        # an `at` with its bracket, wherever _SPELLED allows it
        for hint in _AT.finditer(self.raw):
            at = hint.start()
            r = int(np.searchsorted(t.offsets, at, "right")) - 1
            low, high = max(int(t.start[r]), at - _SPELLED_BEFORE), min(int(t.end[r]), at + _SPELLED_AFTER)
            out += [(r, *m.span()) for m in _SPELLED.finditer(self.raw, low, high) if m.start() < at < m.end()]
        start, end, _ = words(t, _flags(*_ALNUM, 32))
        ok = self.digits[end] - self.digits[start] >= 10
        row = np.searchsorted(t.offsets, start, "right") - 1
        for r, s, e in zip(row[ok].tolist(), start[ok].tolist(), end[ok].tolist(), strict=True):
            for m in _ACCOUNT.finditer(self.raw, s, e):
                # words in capitals may follow: the longest part that passes the check, or the whole
                ends = [m.end(), *(k for k in range(m.end() - 1, m.start(), -1) if self.raw[k] == 32)]
                out.append((r, m.start(), next((k for k in ends if _iban(self.raw[m.start() : k])), m.end())))
        return sorted(set(out))

    def _checked(self, row: int, s: int, e: int) -> int | None:
        """1 or 0 for a candidate whose format can be checked."""
        low, high, span = int(self.texts.start[row]), int(self.texts.end[row]), self.raw[s:e]
        before, after = self.raw[max(low, s - 32) : s], self.raw[e : min(high, e + 1)]
        alone = not before[-1:].isalnum() and not after.isalnum()
        if _ACCOUNT.fullmatch(span):
            return int(alone and _iban(span))
        if _SSN.fullmatch(span):
            return int(alone and before[-1:] != b"-" != after and _ssn(span))
        if _SPELLED.fullmatch(span):
            return 1 if _BRACKETED.fullmatch(span) else None
        if alone and _NATIONAL.fullmatch(span) and _PHONE_CUE.search(before):
            return 1
        return None

    def labelled(self) -> dict[tuple[int, int, int], int]:
        """What the trees may learn from: spans and 1 or 0."""
        gold = {(r, s, e): 1 for r, _, s, e in self.spans}
        found = {c: self._checked(*c) for c in self.candidates()}
        good = _by_row([*gold, *(c for c, y in found.items() if y)])
        cues: dict[int, bool] = {}
        out = {}
        for c, y in {**found, **{(r, s, e): 0 for r, _, s, e in self.failed if not found.get((r, s, e))}}.items():
            r, s, e = c
            # a candidate that overlaps a good span is neither right nor wrong
            if y or (r in good and good[r].touch(s, e)):
                continue
            if y is None:
                if r not in cues:
                    cues[r] = bool(_CUES.search(self.raw, int(self.texts.start[r]), int(self.texts.end[r])))
                if cues[r]:
                    continue
            out[c] = 0
        taken = _by_row(list(gold))
        for c, y in found.items():
            if y and not (c[0] in taken and taken[c[0]].touch(*c[1:])):
                out[c] = 1
        return {**out, **gold}

    def features(self, row: int, s: int, e: int) -> list[float]:
        t, span = self.texts, self.raw[s:e]
        digits = _digits(span)
        before = self.raw[max(int(t.start[row]), s - 32) : s]
        after = self.raw[e : min(int(t.end[row]), e + 8)]
        groups = re.findall(rb"[0-9]+", span)
        return [
            e - s, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            span.count(b"."), span.count(b"-"), span.count(b" "), span.count(b"("), b"@" in span, span[:1] == b"+",
            sum(65 <= c < 91 for c in span), sum(97 <= c < 123 for c in span), luhn(digits) if digits else 0, 13 <= len(digits) <= 19,
            all(len(g) <= 3 for g in groups), len(_CUES.findall(before)), before[-1:].isalnum(), after[:1].isalnum(), before[-2:-1] in (b":", b"="),
            len(set(digits)), bool(re.search(rb"[\[({]\x20?(?i:at)", span)), _iban(span), bool(_SSN.fullmatch(span)) and _ssn(span),
        ]


@dataclass
class PiiModel:
    trees: boosting.BoostedTrees
    slope: float
    shift: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated."""
        return _curve(_score(self.trees, x), self.slope, self.shift)

    def added(self, scan: Scan) -> list[tuple[int, int, int, int]]:
        """Selected candidates that touch no pattern's span; of overlapping ones the likeliest."""
        found = scan.candidates()
        if not found:
            return []
        p = self.probability(np.array([scan.features(*c) for c in found], np.float64))
        taken = _by_row([(r, s, e) for r, _, s, e in scan.spans])
        out = []
        for k in sorted(np.flatnonzero(p >= self.threshold).tolist(), key=lambda k: (-p[k], found[k])):
            r, s, e = found[k]
            mine = taken.setdefault(r, Overlaps([]))
            if not mine.touch(s, e):
                mine.add(s, e)
                out.append((r, 4, s, e))
        return out


def _score(trees: boosting.BoostedTrees, x: np.ndarray) -> np.ndarray:
    p = np.clip(trees.probability(x), 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _curve(score: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * score + shift, -40, 40)))


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve that fits held-back labels best; labels are drawn in a little, as for few rows."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _curve(score, slope, shift)
        g = np.array([((p - goal) * score).sum() + 1e-3 * (slope - 1), (p - goal).sum() + 1e-3 * shift])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope - step[0], shift - step[1]
    return max(float(slope), 1e-3), float(shift)


def train(docs: DataFrame, n_texts: int = TRAIN_TEXTS, n_spans: int = TRAIN_SPANS) -> PiiModel | None:
    """Fit on EXAMPLES and the texts of smallest hash that can hold candidates; one in four spans sets curve and threshold."""
    ship(docs.sparkSession)
    hashed = docs.where(F.col("text").rlike(_MAY_TEACH)).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    chosen = [r["h"] for r in hashed.select("h").orderBy("h").limit(n_texts).collect()]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                scan = Scan(Texts(part.column("text")))
                by_row: dict[int, list] = {}
                for (r, s, e), y in sorted(scan.labelled().items()):
                    if len(mine := by_row.setdefault(r, [])) < n_spans:
                        mine.append([*scan.features(r, s, e), y])
                yield pa.RecordBatch.from_arrays([pa.array([part.column("h")[r].as_py() for r in by_row], pa.int64()), pa.array([np.array(v, np.float32).tobytes() for v in by_row.values()], pa.binary())], ["h", "v"])

    rows = []
    if chosen:  # equal rows teach once
        rows = sorted(hashed.where(F.col("h") <= chosen[-1]).dropDuplicates(["h"]).mapInArrow(sample, "h bigint, v binary").collect())
    written = Scan(Texts(pa.array(EXAMPLES)))
    taught = np.array([[*written.features(*c), y] for c, y in sorted(written.labelled().items())], np.float32)
    data = np.concatenate([*[np.frombuffer(r["v"], np.float32).reshape(-1, taught.shape[1]) for r in rows], taught]).astype(np.float64)
    x, y = data[:, :-1], data[:, -1]
    held = np.arange(len(y)) % 4 == 0
    trees = boosting.fit(x[~held], y[~held])
    score, t = _score(trees, x[held]), y[held]
    slope, shift = calibrate(score, t)
    p = _curve(score, slope, shift)
    order = np.argsort(-p)
    good = np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= PRECISION
    last = np.flatnonzero(good)
    return PiiModel(trees, slope, shift, max(0.5, float(p[order][last[-1]])) if len(last) else 2.0)


def scan_pii(docs: DataFrame, model: PiiModel | None) -> DataFrame:
    """`docs` plus pii: array of (kind, start, end) in code points, by kind as listed, then start."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs, names, (text,) = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "pii"]), "text")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                scan = Scan(Texts(part.column(text)))
                spans = scan.spans + (sent.value.added(scan) if sent.value is not None else [])
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                if spans:
                    chars = np.concatenate([[0], np.cumsum((scan.texts.data & 0xC0) != 0x80)])
                    for row, k, s, e in sorted(spans):
                        base = chars[scan.texts.start[row]]
                        out[row].append({"kind": KINDS[k], "start": int(chars[s] - base), "end": int(chars[e] - base)})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(kind))], [*part.schema.names, "pii"])

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", pii array<struct<kind: string, start: bigint, end: bigint>>").toDF(*names, "pii")
