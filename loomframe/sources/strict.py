"""An exact tokenizer for quotes in the middle of fields; used for headers, and for files in strict mode."""

from __future__ import annotations

import re
from collections.abc import Iterator


def records(text: str, delimiter: str = ",", quote: str = '"') -> Iterator[list[str]]:
    """Raw fields of each record: a quote anywhere toggles quoting; CR, LF and CRLF end a record outside quotes."""
    return (fields for fields, _ in ended_records(text, delimiter, quote))


def ended_records(text: str, delimiter: str = ",", quote: str = '"') -> Iterator[tuple[list[str], int]]:
    """The same, with where each record's line end ends."""
    stop = re.compile(f"[{re.escape(delimiter)}{re.escape(quote)}\r\n]" if quote else f"[{re.escape(delimiter)}\r\n]")
    fields: list[str] = []
    start = at = 0
    n = len(text)
    while at < n:
        m = stop.search(text, at)
        if m is None:
            break
        at, c = m.end(), m[0]
        if c == quote:
            close = text.find(quote, at)
            at = n if close < 0 else close + 1
        elif c == delimiter:
            fields.append(text[start : at - 1])
            start = at
        else:
            fields.append(text[start : at - 1])
            if c == "\r" and text[at : at + 1] == "\n":
                at += 1
            yield fields, at
            fields, start = [], at
    if start < n or fields:
        yield [*fields, text[start:]], n


def field(raw: str, quote: str = '"') -> str | None:
    """The value of a raw field: empty is null, quotes around it go and doubled ones inside become one."""
    if raw == "":
        return None
    if quote and len(raw) > 1 and raw[0] == quote and raw[-1] == quote:
        return raw[1:-1].replace(quote * 2, quote)
    return raw
