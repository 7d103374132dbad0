"""Text normalisation and keys as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters() -> tuple[str, str]:
    """Letters of the Latin blocks that are a plain letter with marks, and that letter."""
    accented, plain = "", ""
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(map(unicodedata.combining, parts[1:])):
            accented, plain = accented + chr(code), plain + parts[0]
    return accented, plain


ACCENTED, PLAIN = _letters()


def normal(text: str | Column) -> Column:
    """Lower case without accents, composed or not, one blank between words, none at the ends."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def words(text: str | Column) -> Column:
    return F.filter(F.split(normal(text), " "), lambda w: w != "")


def almost_equal(a: Column, b: Column) -> Column:
    """Equal, or one edit apart if a has five characters at least."""
    return (a == b) | ((F.length(a) >= 5) & (F.levenshtein(a, b) <= 1))


def fits_into(a: Column, b: Column) -> Column:
    """Every word of array a is almost equal to a word of array b; not for an empty a."""
    return (F.size(a) > 0) & F.forall(a, lambda w: F.exists(b, lambda t: almost_equal(w, t)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the words of array a, repeated ones counted, that array b has."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w))) / F.size(a)


def hex_to_decimal(text: str | Column) -> Column:
    """Up to 16 hexadecimal digits as decimal text, over the whole unsigned range; null for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, 10))


def one_edit_marks(text: str | Column) -> Column:
    """A text and what is left of it without any one of its characters: two texts one edit apart have a mark in common."""
    text = F.col(text) if isinstance(text, str) else text
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(places, lambda i: F.concat(F.substring(text, 1, i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), cut))


# How a position is written in a link or a text, the most telling way first.
_PAIR = r"(-?[0-9]{1,3}\.[0-9]{4,})"
_DOOR, _ASKED, _FRAME, _BARE = f"!3d{_PAIR}!4d{_PAIR}", f"(?i)[?&](?:q|query|destination|ll)={_PAIR}(?:,|%2C){_PAIR}", f"@{_PAIR},{_PAIR}", rf"{_PAIR}[,\s]+{_PAIR}"


def coordinate(text: str | Column, part: int) -> Column:
    """Latitude (1) or longitude (2) in a text: of a link's last door, else of its query, else of its frame, else a pair outside links."""
    text = F.col(text) if isinstance(text, str) else text
    door = F.try_element_at(F.regexp_extract_all(text, F.lit(_DOOR), F.lit(part)), F.lit(-1))
    outside = F.regexp_replace(text, r"https?://\S+", " ")
    others = (F.nullif(F.regexp_extract(x, p, part), F.lit("")) for x, p in ((text, _ASKED), (text, _FRAME), (outside, _BARE)))
    return F.coalesce(door, *others).cast("double")


#: Beginnings of postal codes and their city.
CITIES = {"490": "Aracaju", "4910": "São Cristóvão", "4914": "Barra dos Coqueiros", "4916": "Nossa Senhora do Socorro"}


def city_of_code(code: Column) -> Column:
    digits, out = F.regexp_replace(code, r"\D", ""), None
    for start, city in CITIES.items():
        out = (F if out is None else out).when(digits.startswith(start), city)
    return out


def title(text: Column, small: tuple[str, ...] = ("de", "da", "do", "das", "dos", "e")) -> Column:
    """Every word with a capital, but small ones."""
    words = F.transform(F.split(text, " "), lambda w: F.when(w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))))
    return F.array_join(words, " ")
