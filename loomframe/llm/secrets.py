"""Secret scan: fixed patterns, and a conditional random field over tokens that adds further spans.

Patterns (`assign`, `access`, `hex`) are found exactly.  The field tags the tokens of each line as
outside, begin or inside of a secret, from the token's shape, its neighbours (cue words before it, the
signs around it, whether the tokens beside it are joined to it) and features of the whole text, and is
decoded by Viterbi; its spans that touch no pattern's span are added as `crf`.

It learns from pattern hits in at most TRAIN_DOCS texts, those of smallest hash (of each the first
TRAIN_LINES lines with a hit and QUIET_LINES without, of at most TRAIN_TOKENS tokens, as a line holds
one thing), every second time with the neighbour features blanked, so that shape alone can carry a tag;
and from written lines (`written_lines`) with forms that no pattern knows: other cue words, bearer and
web tokens, passwords in addresses, and their harmless likes.  These bounds hold for learning alone.
Scanning covers all tokens of all texts: lines are passed over only where a bound proves that "outside"
wins everywhere.

Cases: null and empty texts have no spans.  A table without any pattern hit learns from the written
lines.  Rows are judged one by one, each text whole in one task; extra columns of any name stay, but for
`secrets`, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import LOWER, Texts, chunks, plain_names, prefix_hash, range_hash, ship, words

KINDS = ("assign", "access", "hex", "crf")
TRAIN_DOCS = 400
TRAIN_LINES = 6
QUIET_LINES = 4
TRAIN_TOKENS = 120
#: Written lines of each form.
WRITTEN = 12

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_TOKEN[128:] = True
_KIND = np.zeros(256, np.int8)  # of a byte: 1 small, 2 capital, 3 digit, 4 underscore, 5 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[95], _KIND[128:] = 1, 2, 3, 4, 5
#: A text with a pattern hit, for Java's matcher.
_HIT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_CUES = [b"password", b"passwd", b"secret", b"token", b"key", b"apikey", b"api_key", b"api", b"auth", b"bearer", b"credential", b"credentials", b"private", b"pwd", b"access"]


def _cue_hashes() -> np.ndarray:
    joined = np.frombuffer(b"".join(_CUES), np.uint8)
    ends = np.cumsum([len(c) for c in _CUES])
    return np.sort(range_hash(prefix_hash(joined), np.concatenate([[0], ends[:-1]]), ends))


class Scan:
    """Pattern spans and tokens of a chunk of texts.  Spans are (row, kind, start, end) in bytes of the chunk."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.raw = texts.data.tobytes()
        self.spans: list[tuple[int, int, int, int]] = []
        self.values: list[tuple[int, int]] = []  # what is secret in each span
        self._patterns()

    def _rows_with(self, raw: bytes, hints: tuple[bytes, ...]) -> list[int]:
        at: list[int] = []
        for hint in hints:
            k = raw.find(hint)
            while k >= 0:
                row = int(np.searchsorted(self.texts.offsets, k, "right")) - 1
                at.append(row)
                k = raw.find(hint, int(self.texts.end[row]))  # one hit a row is enough
        return sorted(set(at))

    def _patterns(self) -> None:
        t = self.texts
        for row in self._rows_with(self.raw.lower(), _HINTS):
            for m in _ASSIGN.finditer(self.raw, int(t.start[row]), int(t.end[row])):
                if m.end(2) - m.start(2) >= 6:
                    self.spans.append((row, 0, m.start(), m.end())), self.values.append(m.span(2))
        for row in self._rows_with(self.raw, (b"AKIA",)):
            for m in _ACCESS.finditer(self.raw, int(t.start[row]), int(t.end[row])):
                if m.end() - m.start() >= 20:
                    self.spans.append((row, 1, m.start(), m.end())), self.values.append(m.span())
        start, end, _ = words(t, _HEX)
        long = end - start >= 24
        start, end = start[long], end[long]
        for s, e, row in zip(start.tolist(), end.tolist(), (np.searchsorted(t.offsets, start, "right") - 1).tolist(), strict=True):
            self.spans.append((row, 2, s, e)), self.values.append((s, e))

    def tokens(self) -> None:
        """Tokens, the lines they lie in, and their features."""
        t = self.texts
        self.start, self.end, _ = words(t, _TOKEN)
        n = len(self.start)
        data = t.data
        padded = np.concatenate([[10], data, [10, 10]]).astype(np.uint8)
        size = self.end - self.start
        kind = _KIND[data]
        count = lambda flag: (lambda s: s[self.end] - s[self.start])(np.concatenate([[0], np.cumsum(flag)]))
        small, big, digit, high = (count(kind == k) for k in (1, 2, 3, 5))
        shift = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1]), [0]]) if len(kind) else np.zeros(1, np.int64)
        changes = (shift[np.maximum(self.end - 1, 0)] - shift[self.start]) / np.maximum(size, 1)
        hexes = count(_HEX[data]) == size
        row = np.searchsorted(t.offsets, self.start, "right") - 1
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, self.start) + row  # grows at each line and each row
        new = np.ones(n, bool)
        new[1:] = line[1:] != line[:-1]
        self.first = np.concatenate([np.flatnonzero(new), [n]])
        before, after = padded[self.start], padded[self.end + 1]
        two = padded[np.maximum(self.start - 1, 0)]  # two bytes before the token
        joined = np.zeros(n, bool)
        joined[1:] = (self.start[1:] - self.end[:-1] == 1) & ~new[1:] & (before[1:] > 32)
        h = range_hash(prefix_hash(LOWER[data]), self.start, self.end)
        cues = _cue_hashes()
        at = np.minimum(np.searchsorted(cues, h), len(cues) - 1)
        cue = cues[at] == h
        back = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x[:-k]])[:n] if n > k else np.zeros(n, x.dtype)
        near = lambda k: back(cue, k) & (back(line, k) == line) & (np.arange(n) >= k)
        per_row = lambda flag: np.add.reduceat(np.concatenate([flag.astype(np.float64), [0.0]]), np.minimum(t.start, len(flag))) * (t.end > t.start) if t.n else np.zeros(0)
        length = np.maximum(t.end - t.start, 1)
        signs = per_row((data == 61) | (data == 58) | (data == 123))[row] / length[row] if n else np.zeros(0)
        any_cue = np.bincount(row, cue, t.n)[row] > 0 if n else np.zeros(0, bool)
        setter = np.isin(before, [61, 58]) | (np.isin(before, [32, 34, 39]) & np.isin(two, [61, 58, 32, 34, 39]) & np.isin(two, [61, 58]))
        quote = np.isin(before, [34, 39])
        self.x = np.column_stack(
            [
                np.ones(n), size <= 3, (size > 3) & (size < 8), (size >= 8) & (size < 16), (size >= 16) & (size < 24), size >= 24,
                digit > 0, small > 0, big > 0, high > 0, (digit > 0) & (small + big > 0), (digit > 0) & (small > 0) & (big > 0), digit == size, hexes & (digit > 0),
                digit / np.maximum(size, 1), changes, (big > 1) & (small > 0) & (size > 7), (changes > 0.25) & (size > 7), joined,
                setter, quote, np.isin(after, [34, 39]), near(1), near(2), cue,
                any_cue, np.minimum(signs * 20, 1), (before <= 32), (before > 32) & ~setter & ~quote,
            ]
        ).astype(np.float32)
        self.joined, self.row = joined, row

    def gold(self) -> np.ndarray:
        """Tags that the patterns' secret values give: 0 outside, 1 begin, 2 inside."""
        tags = np.zeros(len(self.start), np.int8)
        for s, e in self.values:
            lo, hi = np.searchsorted(self.end, s, "right"), np.searchsorted(self.start, e, "left")
            tags[lo:hi] = 2
            if hi > lo:
                tags[lo] = 1
        return tags

    def found(self, model: crf.ChainModel) -> list[tuple[int, int, int, int]]:
        """Spans of the field that touch no pattern's span."""
        self.tokens()
        if not len(self.start):
            return []
        emit = self.x.astype(np.float64) @ model.weight
        # "outside" everywhere is best where no token could gain more than its two transitions may add
        lift = max(0.0, float((model.move - model.move[0, 0]).max()))
        gain = emit[:, 1:].max(1) - emit[:, 0] + 2 * lift
        lines = np.flatnonzero(np.maximum.reduceat(gain, self.first[:-1]) > 0)
        if not len(lines):
            return []
        lo, hi = self.first[lines], self.first[lines + 1]
        pick = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        tags = crf.viterbi(emit[pick], np.concatenate([[0], np.cumsum(hi - lo)]), model.move)
        out: list[list[int]] = []
        taken = sorted((s, e) for _, _, s, e in self.spans)
        last = -2
        for k in np.flatnonzero(tags).tolist():
            token = int(pick[k])
            if tags[k] == 2 and last == k - 1 and out and pick[k - 1] == token - 1:
                out[-1][3] = int(self.end[token])
            else:
                out.append([int(self.row[token]), 3, int(self.start[token]), int(self.end[token])])
            last = k
        starts = [s for s, _ in taken]
        ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
        keep = []
        for row, kind, s, e in out:
            k = int(np.searchsorted(starts, e)) - 1
            if k < 0 or ends[k] <= s:
                keep.append((row, kind, s, e))
        return keep


def written_lines(n: int = WRITTEN, seed: int = 7) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Lines to learn from and their secrets as (line, start, end); forms in braces are filled by chance."""
    rng = np.random.default_rng(seed)
    small, big, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, low, high: "".join(rng.choice(list(letters), rng.integers(low, high)))
    word = lambda: "".join(str(rng.choice(list("bcdfglmnprstv"))) + str(rng.choice(list("aeiou"))) for _ in range(rng.integers(1, 4))) + str(rng.choice(["", "n", "s", "r"]))
    parts = {
        "mixed": lambda: some(small + big + digits, 16, 44), "short": lambda: some(small + big + digits + "_", 8, 16), "lower": lambda: some(small + digits, 14, 36),
        "web": lambda: f"ey{some(small + big + digits, 14, 30)}.ey{some(small + big + digits, 20, 60)}.{some(small + big + digits + '_', 30, 44)}", "upper": lambda: some(big + digits, 16, 32),
        "prefixed": lambda: f"{some(small, 2, 5)}_{some(small + big + digits, 24, 40)}", "phrase": lambda: f"{word().title()}{rng.integers(10, 9999)}{rng.choice(list('_+=-'))}{word().upper()}{rng.integers(10, 99)}",
        "word": word, "name": lambda: f"{word()}_{word()}", "number": lambda: str(rng.integers(1, 10**6)), "camel": lambda: word() + word().title() + word().title() + word().title(),
        "uuid": lambda: "-".join(some(digits + "abcdef", k, k + 1) for k in (8, 4, 4, 4, 12)), "path": lambda: "/".join(word() for _ in range(rng.integers(3, 7))), "date": lambda: f"20{rng.integers(10, 30)}-{rng.integers(1, 12):02d}-{rng.integers(1, 28):02d}T{rng.integers(10, 23)}:{rng.integers(10, 59)}:00Z",
    }
    cue = lambda: str(rng.choice(["pwd", "credential", "credentials", "private_key", "auth", "access_key", "PRIVATE_KEY", "Pwd", "auth_key", "access"]))
    forms = [
        "CUE: <mixed>", "CUE=<prefixed>", 'CUE = "<short>"', "'CUE': '<phrase>',", "{word}_CUE = <mixed>", "export CUE=<upper>", "CUE: <phrase>", "CUE=<web>", "CUE: <lower>",
        "Authorization: Bearer <web>", "Authorization: Bearer <mixed>", "curl -H 'Authorization: Bearer <prefixed>' https://{word}.{word}/{path}", "{word}: <web>", "{word} {word} <web> {word}", "<prefixed>",
        "postgres://{word}:<mixed>@{word}.{word}:{number}/{word}", "{word} {word} use <prefixed> {word} {word}", 'auth = "<lower>"',
        "{word} {word} {word} {word} {word} {word} {word}.", "{word} {word}, the CUE of {word} {word} was {word}.", "{name} = {number}", "{word}: {word} {word}", "commit {word} at {date}", "id={uuid}", "https://{word}.{word}/{path}?{word}={number}",
        "{camel}({name}, {camel})", "{word} CUE: {word} {word} {word}", "import {camel} from '{path}'", "{word} {number}, {number} {word}; {word}-{word}", "{date} {uuid} {camel} {word}", "{word}/{path}/{camel}.{word}", "CUE: required", "the {word} CUE is {word}", "{number}{word} {word}{number} {camel}{number}",
    ]
    lines, secrets = [], []
    for k in range(n * len(forms)):
        form, line, at = forms[k % len(forms)].replace("CUE", cue()), "", 0
        for m in re.finditer(r"<(\w+)>|\{(\w+)\}", form):
            line += form[at : m.start()]
            made = parts[m[1] or m[2]]()
            if m[1]:
                secrets.append((k, len(line), len(line) + len(made)))
            line, at = line + made, m.end()
        lines.append(line + form[at:])
    return lines, secrets


def _written() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lines, secrets = written_lines()
    scan = Scan(Texts(pa.array(lines)))
    start = scan.texts.start.tolist()
    scan.values += [(start[k] + s, start[k] + e) for k, s, e in secrets]
    scan.tokens()
    return scan.x, scan.gold(), np.diff(scan.first)


def train(docs: DataFrame, n_docs: int = TRAIN_DOCS, n_lines: int = TRAIN_LINES) -> crf.ChainModel:
    """Fit on the written lines and on texts with pattern hits: those of smallest hash, `n_docs` at most."""
    ship(docs.sparkSession)
    hashed = docs.where(F.col("text").rlike(_HIT)).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    chosen = [r["h"] for r in hashed.select("h").orderBy("h").limit(n_docs).collect()]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                scan = Scan(Texts(part.column("text")))
                scan.tokens()
                tags, out = scan.gold(), []
                lines = np.column_stack([scan.first[:-1], scan.first[1:]])[np.diff(scan.first) <= TRAIN_TOKENS]
                hit = np.add.reduceat(tags > 0, scan.first[:-1])[np.diff(scan.first) <= TRAIN_TOKENS] > 0 if len(tags) else np.zeros(0, bool)
                for r in range(part.num_rows):
                    mine = scan.row[lines[:, 0]] == r
                    at = [*lines[mine & hit][:n_lines].tolist(), *lines[mine & ~hit][:QUIET_LINES].tolist()] if (mine & hit).any() else []
                    if at:
                        x = np.concatenate([scan.x[a:b] for a, b in at]).astype(np.float16)
                        out.append((part.column("h")[r].as_py(), x.tobytes(), np.concatenate([tags[a:b] for a, b in at]).tobytes(), np.array([b - a for a, b in at], np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3)]], ["h", "x", "tags", "sizes"])

    rows = []
    if chosen:  # equal rows teach once
        hits = hashed.where(F.col("h") <= chosen[-1]).dropDuplicates(["h"]).mapInArrow(sample, "h bigint, x binary, tags binary, sizes binary")
        rows = sorted(hits.collect(), key=lambda r: (r["h"], r["x"]))
    x, tags, sizes = _written()
    x, tags, sizes = [x], [tags], [sizes]
    for r in rows:
        x.append(np.frombuffer(r["x"], np.float16).reshape(-1, x[0].shape[1]).astype(np.float32))
        tags.append(np.frombuffer(r["tags"], np.int8)), sizes.append(np.frombuffer(r["sizes"], np.int32))
    x, tags = np.concatenate(x), np.concatenate(tags)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    blank = x.copy()
    blank[:, 22:26] = 0  # cues near the token and in the text
    return crf.fit(np.concatenate([x, blank]), np.concatenate([tags, tags]), np.concatenate([first, first[1:] + first[-1]]), 3, forbidden=[(0, 2)])


def scan_secrets(docs: DataFrame, model: crf.ChainModel | None) -> DataFrame:
    """`docs` plus secrets: array of (kind, start, end) in code points, by start, then kind as listed."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs, names, (text,) = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"]), "text")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                scan = Scan(Texts(part.column(text)))
                spans = scan.spans + (scan.found(sent.value) if sent.value is not None else [])
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                if spans:
                    chars = np.concatenate([[0], np.cumsum((scan.texts.data & 0xC0) != 0x80)])
                    for row, k, s, e in sorted(spans, key=lambda x: (x[0], x[2], x[1], x[3])):
                        base = chars[scan.texts.start[row]]
                        out[row].append({"kind": KINDS[k], "start": int(chars[s] - base), "end": int(chars[e] - base)})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(kind))], [*part.schema.names, "secrets"])

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", secrets array<struct<kind: string, start: bigint, end: bigint>>").toDF(*names, "secrets")
