"""Text, number and date functions as Column -> Column; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import FOREIGN, NAME_STOP_WORDS, NOT_FOREIGN

_EDGE = " .,;-"


@cache
def _unmarked() -> tuple[str, str, str]:
    """(one, its replacements, more): characters that compatibility decomposition without combining marks turns into one other or,
    at the end of `one`, into none; and those that it turns into several.  From the tables of Python's Unicode version."""
    one, gone, more = {}, [], []
    for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))):
        plain = _plain(c)
        if not plain:
            gone.append(c)
        elif len(plain) > 1:
            more.append(c)
        elif plain != c:
            one[c] = plain
    return "".join(one) + "".join(gone), "".join(one.values()), "".join(more)


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@cache
def _several() -> tuple[str, list[tuple[str, str]]]:
    """A pattern for the characters that become several, and a translation for each place of what they become: those with nothing at
    a place vanish there."""
    more = sorted(_unmarked()[2], key=lambda c: (-len(_plain(c)), c))
    places = [(more, [_plain(c)[k] for c in more if len(_plain(c)) > k]) for k in range(len(_plain(more[0])))]
    codes = sorted(map(ord, more))
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    stops = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, stops, strict=True)) + "]", [("".join(x), "".join(y)) for x, y in places]


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) where f names its argument several times: c is worked out once a row, which Spark does not see to in branches and inside
    functions of arrays."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unmarked(c: Column) -> Column:
    """Compatibility decomposition without combining marks: `Dvořák` is `Dvorak`, a ligature its letters.  One translation serves
    all characters that become one; only texts that hold others are gone through character by
    character.  Plain ASCII is left as it is."""
    one, plain, _ = _unmarked()
    pattern, places = _several()
    # The pattern has hundreds of ranges, so whole texts meet it with what isn't ASCII only.
    holds = lambda x: F.regexp_replace(x, r"[\x00-\x7F]+", "").rlike(pattern)
    several = lambda x: F.array_join(F.transform(F.split(x, ""), lambda y: F.when(y.rlike(pattern), F.concat(*(F.translate(y, a, b) for a, b in places))).otherwise(y)), "")
    return once(c, lambda x: F.when(~x.rlike(r"[^\x00-\x7F]"), x).otherwise(F.translate(F.when(holds(x), several(x)).otherwise(x), one, plain)))


def fold(c: Column) -> Column:
    """Upper case without marks, compatibility forms taken apart; null becomes an empty text."""
    return F.upper(unmarked(F.coalesce(c, F.lit(""))))


def normal_spaces(c: Column) -> Column:
    """No-break and zero-width spaces as spaces, runs collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ​]+", " "))


def clean(c: Column) -> Column:
    """normal_spaces, ends stripped of ` .,;-`, upper case; null stays null."""
    return F.upper(F.btrim(normal_spaces(c), F.lit(_EDGE)))


def party_key(c: Column) -> Column:
    """Comparison key of a name: folded, only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(fold(clean(c)), r"[^A-Z0-9]+", " "))


def name_core(c: Column) -> Column:
    """Words of the key that tell companies apart, else all of them."""

    def core(words: Column) -> Column:
        return once(F.filter(words, lambda x: ~x.isin(*NAME_STOP_WORDS)), lambda some: F.when(F.size(some) > 0, some).otherwise(words))

    return once(F.filter(F.split(party_key(c), " "), lambda x: x != ""), core)


def header(c: Column) -> Column:
    """Column heads: trimmed, lower case, no marks."""
    return F.lower(unmarked(F.trim(c)))


#: A spreadsheet's serial number of a day.
SERIAL = r"^\d{1,6}(\.\d+)?$"


def date_of(c: Column) -> Column:
    """dd/mm/yyyy, dd/mm/yy, yyyy-mm-dd or a spreadsheet's serial number; else null."""
    s = F.trim(c)
    by = [F.when(s.rlike(p), F.try_to_date(s, f)) for p, f in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"))]
    serial = F.when(s.rlike(SERIAL), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(s.try_cast("double")).cast("int")))
    return F.coalesce(*by, serial)


def date_note(c: Column) -> Column:
    """What is odd about a date's form; null if nothing can be said."""
    s = F.trim(c)
    return F.when(s.isNull() | (s == ""), "data ausente").when(date_of(c).isNull(), "data invalida").when(s.rlike(SERIAL), "data gravada como numero de serie").otherwise("data gravada como texto")


def number(c: Column) -> Column:
    """1.234,56 as a double; null if it isn't one."""
    s = F.trim(c)
    return F.when(s.rlike(r"^-?[\d.]*,?\d+$|^-?[\d.]+,$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def amount(c: Column) -> Column:
    """Like number, with parentheses or a leading minus for negative; missing or unreadable is 0."""
    s = F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    bare = F.replace(F.replace(F.regexp_replace(s, "^-+", ""), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(F.when(s.startswith("-"), -bare).otherwise(bare), F.lit(0.0))


def brazilian(c: Column, digits: int = 2) -> Column:
    """A number as 1.234,56."""
    return F.translate(F.format_number(c, digits), ",.", ".,")


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def bare_number(c: Column) -> Column:
    """A note's number without leading zeros; 0 if nothing is left."""
    s = F.ltrim(c, F.lit("0"))
    return F.when(s == "", "0").otherwise(s)


def category(c: Column) -> Column:
    return F.when(c.startswith("SUCATA"), "SUCATA").when(c.startswith("LINGOTE"), "LINGOTE").otherwise("OUTRO")


def metal(c: Column) -> Column:
    out = F.when(c.contains("ALUMINIO"), "ALUMINIO")
    for m in ("MAGNESIO", "COBRE", "SILICIO"):
        out = out.when(c.contains(m), m)
    return out


def foreign(c: Column) -> Column:
    return once(fold(c), lambda x: x.rlike(FOREIGN) & ~x.rlike(NOT_FOREIGN))


def unit_cost(value: Column, quantity: Column) -> Column:
    """value / quantity; null where either is missing or 0."""
    return F.when((value != 0) & (quantity != 0), value.cast("double") / quantity.cast("double"))


def full_cst(origin: Column, cst: Column) -> Column:
    """Origin and code side by side; null unless both are there."""
    return F.when((origin != "") & (cst != ""), F.concat(origin, cst))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common start of two texts, cut at its last space."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda k, i: F.when((i == k + 1) & (F.substring(a, 1, i) == F.substring(b, 1, i)), i).otherwise(k))
    return F.char_length(F.regexp_extract(F.substring(a, 1, same), r"^(.*)\s", 1))
