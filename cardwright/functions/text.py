"""Column functions on card texts. None of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def normalized(c: Column) -> Column:
    """Lower case, ё as е, only digits, Latin and Cyrillic letters, single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), "[^0-9a-zа-яё]+", " "))


def model_text(name: Column, description: Column, limit: int = 2500) -> Column:
    """What a text model reads of a card."""
    return collapsed(F.replace(F.lower(F.concat(name, F.lit(" \n "), F.substring(description, 1, limit))), F.lit("ё"), F.lit("е")))


def digest(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 16)


TAGS = ("<комментарий>", "<вердикт>")
STRIPPED = " ,;:-"


def clipped(c: Column, fallback: str, least: int = 50, most: int = 300) -> Column:
    """A comment of least to most characters: spaces collapsed and the answer's tags taken out, long ones cut at the last
    space if that keeps more than least, short ones followed by the fallback, and at last filled with spaces."""
    plain = collapsed(F.coalesce(c, F.lit("")))
    for tag in TAGS:
        plain = F.replace(plain, F.lit(tag), F.lit(" "))
    plain = F.trim(plain)
    plain = F.when(plain == "", F.lit(fallback)).otherwise(plain)
    head = F.substring(plain, 1, most + 1)
    back = F.locate(" ", F.reverse(head))
    at = F.when(back > 0, F.length(head) - back).otherwise(-1)
    short = F.rtrim(F.when(at > least, F.substring(head, F.lit(1), at)).otherwise(F.substring(head, 1, most)), F.lit(STRIPPED))
    done = F.when(F.length(plain) > most, short).otherwise(plain)
    longer = F.substring(collapsed(F.concat(F.rtrim(done, F.lit(". ")), F.lit(". " + fallback))), 1, most)
    done = F.when(F.length(done) < least, longer).otherwise(done)
    return F.rpad(done, F.greatest(F.lit(least), F.length(done)), F.lit(" "))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """The template with {name} replaced by the field; names without a field by nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else F.coalesce(fields.get(x, F.lit("")), F.lit("")) for i, x in enumerate(parts)])


def inserted(text: Column, marker: str, what: Column) -> Column:
    """what, put before the marker's first place; a text without the marker is an error."""
    at = F.locate(marker, text)
    found = F.concat(F.substring(text, F.lit(1), at - 1), what, F.substring(text, at, F.length(text)))
    return F.when(at > 0, found).otherwise(F.raise_error(F.lit(f"no place for the insertion: {marker}")).cast("string"))


def tail_replaced(text: Column, marker: str, tail: Column) -> Column:
    """The text before the marker's first place, and tail; a text without the marker is an error."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), tail)).otherwise(F.raise_error(F.lit(f"no direct question: {marker}")).cast("string"))


def frame_size(width: Column, height: Column, most: int, step: int) -> tuple[Column, Column]:
    """Both sides, at most so many pixels in all, as multiples of step and two steps at least; frames that fit stay."""
    area = width * height
    fits = (area <= most) & (width % step == 0) & (height % step == 0)
    scale = F.when(area > most, F.sqrt(F.lit(float(most)) / area)).otherwise(1.0)
    side = lambda x: F.when(fits, x).otherwise(F.greatest(F.lit(2), F.floor(F.floor(x * scale) / step)) * step).cast("long")
    return side(width), side(height)


def answer(comment: Column, verdict: Column) -> Column:
    """The answer's format is fixed."""
    return F.concat(F.lit("<комментарий>"), comment, F.lit("<вердикт>"), F.when(verdict == 1, "не бан").otherwise("бан"))


def first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern is found."""
    out = F.when(c.rlike(rules[0][1]), F.lit(rules[0][0]))
    for name, pattern in rules[1:]:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(default)
