"""Functions that no column expression can express: a pattern built of each row's words, and addresses decoded until they
stay the same. Arrow-batched, one small helper for each row."""

from __future__ import annotations

import datetime as dt
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: A cycle reaches no further back than this, so that another purchase at the same shop is no evidence.
MOST_DAYS = 370
SECRET = re.compile(r"(?i)[?&;#](?:[\w.-]*(?:token|secret|password|passwd|signature|session|api_?key|auth|otp|code))=|//[^/?#\s]*@")


_HEAD, _SPACE = re.compile(r"(?:^|\n)\s*(\d{1,2})\s+"), re.compile(r"\s+")
_TAIL = re.compile(r"[^\n]*\n\s*([A-Za-z]{3,9})\s+(\d{4}|\d{2})\b", re.IGNORECASE)


def _around(text: str, words: list[str]) -> tuple[str, str, str] | None:
    """(day, month, year) around the words. A pattern made of each row's words takes longer to build than to look for: ASCII texts,
    in which case is plain, are walked from line to line with patterns that stay the same."""
    if not text.isascii() or not all(map(str.isascii, words)):
        told = r"\s+".join(map(re.escape, words))
        m = re.search(rf"(?:^|\n)\s*(\d{{1,2}})\s+{told}[^\n]*\n\s*([A-Za-z]{{3,9}})\s+(\d{{4}}|\d{{2}})\b", text, re.IGNORECASE)
        return m and m.groups()
    low, told, at = text.lower(), [w.lower() for w in words], 0
    while head := _HEAD.search(low, at):
        end = head.end()
        for i, w in enumerate(told):
            gap = _SPACE.match(low, end) if i else None
            end = gap.end() if gap else end
            if i and not gap or not low.startswith(w, end):
                break
            end += len(w)
        else:
            if tail := _TAIL.match(text, end):
                return head[1], tail[1], tail[2]
        at = head.start() + 1
    return None


def split_date(text: str | None, description: str | None, statement: dt.date | None) -> dt.date | None:
    """The day before a description at a line's start, with month and year at the start of the next line."""
    words = (description or "").split()[:8]
    if not words or not text or statement is None:
        return None
    found = _around(text, words)
    if not found or found[1][:3].lower() not in MONTHS:
        return None
    day_, month, year = found
    try:
        day = dt.date(int(year) + (2000 if len(year) == 2 else 0), MONTHS.index(month[:3].lower()) + 1, int(day_))
    except ValueError:
        return None
    return day if (statement - day).days <= MOST_DAYS else None


@F.pandas_udf(DateType())
def recovered_date(text: pd.Series, description: pd.Series, statement: pd.Series) -> pd.Series:
    day = lambda s: s if type(s) is dt.date else None if s is None or pd.isna(s) else pd.Timestamp(s).date()
    return pd.Series([split_date(t, d, day(s)) for t, d, s in zip(text, description, statement)], dtype=object)


def decoded(text: str, passes: int = 8) -> str:
    for _ in range(passes):
        new = unquote(text)
        if new == text:
            break
        text = new
    return text


def hide_secrets(text: str | None) -> str | None:
    """text with the addresses hidden that, decoded to the end, carry a secret or a user's name."""
    return None if text is None else re.sub(r"(?i)\bhttps?(?::|%3a)[^\s\"'<>)]+", lambda m: "[redacted-url]" if SECRET.search(decoded(m[0])) else m[0], text)


@F.pandas_udf(StringType())
def without_secret_urls(texts: pd.Series) -> pd.Series:
    return texts.map(hide_secrets, na_action=None)


# ---------------------------------------------------------------- text of PDF files

#: A file of more pages, or of more characters in all, is refused.
MOST_PAGES, MOST_CHARS = 64, 1_000_000
#: What a compressed stream may come to.
MOST_BYTES = 16 * MOST_CHARS
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
    raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return raw.decode("latin-1")


class Oversized(ValueError):
    """A file over a limit."""


def _streams(data: bytes):
    """(what stands before a stream, its bytes) for each stream of a file that can be read."""
    import zlib

    for m in re.finditer(rb"<<(?P<head>(?:[^<>]|<(?!<)|>(?!>)|<<.*?>>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", data, re.DOTALL):
        body = m["body"]
        if b"/FlateDecode" in m["head"]:
            try:
                unpack = zlib.decompressobj()
                body = unpack.decompress(body, MOST_BYTES)
            except zlib.error:
                continue
            if unpack.unconsumed_tail:
                raise Oversized
        yield m["head"], body


_NUMBERED = re.compile(rb"[-+]?\d*\.?\d+|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[dDmLjJ*]|T\*|\bBT\b|\bET\b|['\"](?=\s)", re.DOTALL)


def _lines(body: bytes) -> list[str]:
    """Lines that a content stream shows, from the top of the page to its bottom; lines at one height from left to right."""
    placed: list[tuple[float, float, int, str]] = []
    x = y = lead = 0.0
    own, pending, operands = "", "", []

    def line(dx: float = 0.0, dy: float = 0.0, at: tuple[float, float] | None = None):
        """Ends the line and goes on elsewhere."""
        nonlocal own, x, y
        if own:
            placed.append((-y, x, len(placed), own))
        own, (x, y) = "", at or (x + dx, y + dy)

    for token in _NUMBERED.findall(body):
        if token[:1] in b"(<":
            pending += _literal(token)
            continue
        if token[:1] in b"+-.0123456789":
            operands.append(float(token))
            continue
        if token in (b"Tj", b"TJ"):
            own += pending
        elif token in (b"'", b'"'):  # a new line, and the string on it
            line(dy=-lead)
            own = pending
        elif token == b"T*":
            line(dy=-lead)
        elif token in (b"Td", b"TD") and len(operands) >= 2:
            line(*operands[-2:])
            lead = -operands[-1] if token == b"TD" else lead
        elif token == b"Tm" and len(operands) >= 6:
            line(at=tuple(operands[-2:]))
        elif token == b"TL" and operands:
            lead = operands[-1]
        elif token in (b"BT", b"ET"):
            line(at=(0.0, 0.0) if token == b"BT" else None)
        pending, operands = "", []
    line()
    return [shown for *_, shown in sorted(placed)]


def read_pdf(data: bytes | None) -> tuple[str | None, int | None, str | None]:
    """(text, pages, reason). Lines of each content stream from top to bottom. What is no PDF has the reason not_pdf, an encrypted file encrypted, and
    one over a limit oversized; they have no text, as a part of it would pass for the whole. Fonts with encodings of their own are not read."""
    if data is None:
        return None, None, None
    if not data.startswith(b"%PDF"):
        return None, None, "not_pdf"
    if re.search(rb"/Encrypt\b", data):
        return None, None, "encrypted"
    try:
        pages, shown, size = len(re.findall(rb"/Type\s*/Page\b(?!s)", data)), [], 0
        for head, body in _streams(data):
            if b"/ObjStm" in head:
                pages += len(re.findall(rb"/Type\s*/Page\b(?!s)", body))
            elif re.search(rb"\bBT\b", body):
                shown.append("\n".join(_lines(body)))
                size += len(shown[-1]) + 1
        pages = pages or len(shown)
        if pages > MOST_PAGES or size > MOST_CHARS + 1:
            raise Oversized
    except Oversized:
        return None, None, "oversized"
    return "\n".join(shown), pages, None


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("pages", IntegerType()), StructField("reason", StringType())]))
def read_pdfs(files: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([read_pdf(f) for f in files], columns=["text", "pages", "reason"])
    return found.astype({"pages": "Int32"})
