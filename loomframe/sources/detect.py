"""What the first bytes of a file say: encoding, delimiter, line ends.  Pure functions on the driver."""

from __future__ import annotations

from collections import Counter

#: Byte order marks, longest first.
MARKS = ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))
DELIMITERS = (",", "\t", "|", ";")
SAMPLE_BYTES, SAMPLE_ROWS = 8192, 10


def detect_mark(head: bytes) -> tuple[str | None, int]:
    """(encoding, bytes of the mark)."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name, len(mark)
    return None, 0


def detect_encoding(head: bytes) -> str:
    name, _ = detect_mark(head)
    if name:
        return name
    sample = head[:1024]
    if sample and sample.count(0) > len(sample) / 3:
        return "UTF-16BE" if sample[0] == 0 else "UTF-16LE"
    try:
        sample.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(sample) - 3:  # not a character cut off at the end
            return "windows-1252"
    return "UTF-8"


def fields_in_rows(text: str, delimiter: str, quote: str = '"', rows: int = SAMPLE_ROWS) -> list[int]:
    """Fields of each of the first rows, delimiters and line ends in quotes not counted."""
    out, n, inside, some = [], 1, False, False
    for c in text:
        if c == quote:
            inside, some = not inside, True
        elif inside:
            continue
        elif c == delimiter:
            n, some = n + 1, True
        elif c in "\n\r":
            if some:
                out.append(n)
            n, some = 1, False
            if len(out) == rows:
                return out
        else:
            some = True
    return [*out, n] if some else out


def detect_delimiter(text: str, candidates: tuple[str, ...] | list[str] = DELIMITERS, quote: str = '"') -> str:
    """The candidate with the best mean of fields times share of rows that agree; a comma if none splits."""
    best, most = ",", 0.0
    for c in candidates:
        counts = fields_in_rows(text[:SAMPLE_BYTES], c, quote)
        mean = sum(counts) / len(counts) if counts else 0
        score = mean * Counter(counts).most_common(1)[0][1] / len(counts) if mean > 1 else 0.0
        if score > most:
            best, most = c, score
    return best


def detect_linebreak(text: str) -> str:
    at = min((k for k in (text.find("\n"), text.find("\r")) if k >= 0), default=-1)
    return "\n" if at < 0 else "\r\n" if text[at : at + 2] == "\r\n" else text[at]
