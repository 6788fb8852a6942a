"""Functions that Spark's own cannot express, as Arrow-batched UDFs: exact case folding, Windows names, .NET numbers, CP932."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = re.compile(r"^(CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])(\.|$)", re.I)
FORBIDDEN = re.compile(r'[\x00-\x1f<>:"|?*]')


def fold_text(text: str) -> str:
    """Upper case code point by code point: a letter whose upper case is longer stays as it is."""
    if text.isascii():
        return text.upper()
    return "".join(u if len(u := c.upper()) == 1 else c for c in text)


def canonical_windows_path(path: str) -> tuple[str | None, str | None]:
    """(absolute path with a drive, None), or (None, what is wrong). Lexical: nothing is looked up."""
    text = path.replace("/", "\\")
    if text.startswith(("\\\\?\\", "\\\\.\\", "\\??\\")):
        return None, "DEVICE_PATH"
    if not re.match(r"^[A-Za-z]:\\", text):
        return None, "NOT_ABSOLUTE"
    out: list[str] = []
    for part in text[3:].split("\\"):
        if part in ("", "."):
            continue
        if part == "..":
            if not out:
                return None, "ESCAPES_ROOT"
            out.pop()
        elif FORBIDDEN.search(part):
            return None, "INVALID_CHARACTER"
        elif part[-1] in ". ":
            return None, "TRAILING_DOT_OR_SPACE"
        elif RESERVED.match(part):
            return None, "RESERVED_NAME"
        else:
            out.append(part)
    return text[0].upper() + ":\\" + "\\".join(out), None


def dotnet_number(x: float) -> str:
    """The shortest text that reads back as x, as .NET writes it: 1, 0.5, 1E-05, 1E+16."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    digits, _, exponent = repr(float(x)).partition("e")
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    whole, _, part = digits.partition(".")
    number = (whole + part).lstrip("0")
    scale = len(whole) + int(exponent or 0) - (len(whole + part) - len(number)) if number else 1
    number = number.rstrip("0")
    if not number:
        return sign + "0"
    if -4 < scale <= 15:
        if scale <= 0:
            return f"{sign}0.{'0' * -scale}{number}"
        return sign + (number.ljust(scale, "0") if len(number) <= scale else f"{number[:scale]}.{number[scale:]}")
    e = scale - 1
    return f"{sign}{number[0]}{'.' + number[1:] if len(number) > 1 else ''}E{'+' if e >= 0 else '-'}{abs(e):02d}"


def decodings(raw: bytes, text_format: bool = True) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(encoding, state, text) of each strict reading of the bytes, and diagnostic codes."""
    bom = raw.startswith(b"\xef\xbb\xbf")
    read: dict[str, str] = {}
    for encoding, wanted, data in (("utf-8", True, raw[3:] if bom else raw), ("cp932", text_format and not bom, raw)):
        if wanted:
            try:
                read[encoding] = data.decode(encoding)
            except UnicodeDecodeError:
                pass
    out, codes = [], []
    if "utf-8" in read:
        out.append(("UTF-8-BOM" if bom else "UTF-8", "OBSERVED", read["utf-8"]))
    if "cp932" in read and read["cp932"] != read.get("utf-8"):
        out.append(("CP932", "AMBIGUOUS" if out else "POTENTIAL", read["cp932"]))
    if len(out) == 2:
        codes.append("AMBIGUOUS_ENCODING")
    if not out:
        codes.append("DECODING_FAILED")
    if any("\0" in t for _, _, t in out):
        codes.append("NUL_IN_TEXT")
    return out, codes


def duplicate_keys(text: str) -> str | None:
    """The first member name that an object of the JSON text has twice; empty if none; null if it isn't JSON."""
    found: list[str] = []

    def pairs(items):
        seen = set()
        for k, _ in items:
            if k in seen:
                found.append(k)
            seen.add(k)
        return dict(items)

    try:
        json.loads(text, object_pairs_hook=pairs)
    except (ValueError, RecursionError):
        return None
    return found[0] if found else ""


@F.pandas_udf(T.StringType())
def fold_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
def win_canonical(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else canonical_windows_path(x) for x in s], columns=["value", "error"])


@F.pandas_udf(T.StringType())
def dotnet_double(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else dotnet_number(x))


@F.pandas_udf(T.StringType())
def json_duplicate_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else duplicate_keys(x))
