"""Attribute values as JSON texts: their class, text and number, and predicates over them and over the fixed fields."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Literal = str | int | float | bool

# Severity levels by their first and last number, span kinds, span statuses.
LEVELS = {"trace": (1, 4), "debug": (5, 8), "info": (9, 12), "warn": (13, 16), "error": (17, 20), "fatal": (21, 24)}
KINDS = {"internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
STATUSES = {"unset": 0, "ok": 1, "error": 2}


#: What a text must be to equal a number: no blanks, no signs within digits, no digits of other scripts.
WHOLE, NUMBER = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def key_of(key: str) -> Column:
    if '"' in key:
        raise ValueError(f"a key can't have a double quote: {key}")
    return F.lit(key)


def value(attributes: str, key: str) -> Column:
    """The JSON text of an attribute, null if it is missing."""
    return F.try_element_at(F.col(attributes), key_of(key))


def json_type(text: Column) -> Column:
    head = F.substring(text, 1, 1)
    number = F.when(text.rlike(r"[.eE]"), "float").otherwise("int")
    return F.when(head == '"', "string").when(head.isin("t", "f"), "bool").when(head == "n", "null").when(head == "[", "array").when(head == "{", "object").when(text.isNotNull(), number)


def text_of(text: Column) -> Column:
    """The value as text: a string without its quotes and escapes, a boolean as 1 or 0, null as null."""
    escaped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]
    string = F.when(F.contains(text, F.lit("\\")), escaped).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))
    return F.when(text.startswith('"'), string).when(text == "true", "1").when(text == "false", "0").when(text != "null", text)


def _is_whole(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]{1,38}$|^true$|^false$")


def _number(text: Column, kind: str) -> Column:
    """Numbers, and booleans as 1 and 0, as a decimal or a double; null for all else."""
    one, zero = F.lit(1).cast(kind), F.lit(0).cast(kind)
    return F.when(text == "true", one).when(text == "false", zero).when(text.rlike(r"^-?[0-9]"), text.try_cast(kind))


def is_number(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]|^true$|^false$")


def _versus(text: Column, x: Literal, act: Callable[[Column, Column], Column]) -> Column:
    """act(number, x): whole numbers of any size exactly, all else as doubles; null if the value is no number."""
    near = act(_number(text, "double"), F.lit(float(x)))
    if isinstance(x, float):
        return near
    return F.when(_is_whole(text), act(_number(text, "decimal(38,0)"), F.lit(str(int(x))).try_cast("decimal(38,0)"))).otherwise(near)


def _plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(x)


def _string(text: Column) -> Column:
    return F.when(text.startswith('"') | text.rlike(r"^[\[{]"), text_of(text))


def equals(text: Column, x: Literal) -> Column:
    """Equality of value sets: the number 7 and the string "7" are both equal to 7 and to "7". Null for a missing value."""
    same_as = lambda n: _versus(text, n, lambda a, b: a == b)
    if isinstance(x, bool):
        same, other = same_as(x), F.lit(False)
    elif isinstance(x, int | float):
        same, other = same_as(x), _string(text) == (str(x) if isinstance(x, int) else _plain(x))
    else:
        same = same_as(int(x)) if WHOLE.fullmatch(x) else same_as(float(x)) if NUMBER.fullmatch(x) else F.lit(False)
        other = _string(text) == x
    return F.when(text.isNotNull() & (text != "null"), F.coalesce(same, F.lit(False)) | F.coalesce(other, F.lit(False)))


def is_in(text: Column, xs: list[Literal]) -> Column:
    out = equals(text, xs[0])
    for x in xs[1:]:
        out = out | equals(text, x)
    return out


def keep_unless(condition: Column) -> Column:
    """NOT that keeps what lacks the value."""
    return ~F.coalesce(condition, F.lit(False))


def differs(text: Column, x: Literal) -> Column:
    return keep_unless(equals(text, x))


def compares(text: Column, op: str, x: Literal) -> Column:
    """Order across types: numbers come before all texts, and nothing is converted."""
    act = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    above, number, string = F.lit(op in (">", ">=")), is_number(text), _string(text)
    if isinstance(x, str):
        return F.when(number, ~above).when(string.isNotNull(), act(string, F.lit(x)))
    return F.when(number, _versus(text, x, act)).when(string.isNotNull(), above)


def contains(text: Column, part: str) -> Column:
    return F.contains(text_of(text), F.lit(part))


def has(attributes: str, key: str) -> Column:
    return F.map_contains_key(F.col(attributes), key_of(key))


def level(severity: Column, op: str, x: str | int) -> Column:
    """A level name is a range of severities; a number is that severity."""
    low, high = LEVELS["warn" if x == "warning" else x] if isinstance(x, str) else (x, x)
    return {"=": severity.between(low, high), "!=": ~severity.between(low, high), "<": severity < low, "<=": severity <= high, ">": severity > high, ">=": severity >= low}[op]


def level_name(severity: Column) -> Column:
    out = F.lit("unspecified")
    for name, (low, high) in LEVELS.items():
        out = F.when(severity.between(low, high), name).otherwise(out)
    return out


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the letters without, by canonical decomposition."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and chr(c).islower()]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def tokens_line(text: Column) -> Column:
    """Lower-case tokens of letters and digits, marks stripped, each with a space on both sides."""
    low = F.regexp_replace(F.translate(F.lower(text), *_plain_letters()), r"\p{Mn}+", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def matches_line(line: Column, words: str) -> Column:
    """matches_text over a line that tokens_line made: for several searches in one text, make the line a column first."""
    if not words.split():
        return F.lit(True)
    table = str.maketrans(*_plain_letters())
    bare = lambda w: "".join(c for c in w.lower().translate(table) if unicodedata.category(c) != "Mn")
    phrases = [" ".join("".join(c if c.isalnum() else " " for c in bare(w)).split()) for w in words.split()]
    phrases = [p for p in phrases if p]
    if not phrases:
        return F.lit(False)
    out = F.lit(True)
    for p in phrases:
        out = out & F.contains(line, F.lit(f" {p} "))
    return out


def matches_text(text: Column, words: str) -> Column:
    """Every white-space separated word of `words` occurs as whole tokens, a word with inner punctuation as a phrase.

    No words match all texts; words without a letter or digit are ignored next to others and alone match nothing.
    """
    return matches_line(tokens_line(text), words)
