"""Text normalisation, phonetic codes and number formats as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped, and the one ending dropped, from names.
STOP_WORDS = ("de", "da", "do", "das", "dos")
ENDINGS = ("junior", "jr", "neto", "bisneto", "filho", "filha", "sobrinha", "sobrinho", "segundo", "terceiro")
#: What a CSV reader of the data-frame kind takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Letters that become several, or that have no decomposition (fixed values).
SEVERAL = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ŋ": "ng", "°": "deg", "º": "o", "ª": "a"}
_SINGLE = {"ı": "i", "ð": "d", "ĸ": "k", "ſ": "s", "²": "2", "³": "3", "¹": "1", "–": "-", "—": "-", "’": "'", "‘": "'", "“": '"', "”": '"'}
SEVERAL |= {"½": "1/2", "¼": "1/4", "¾": "3/4", "№": "no"}


def accent_table() -> tuple[str, str]:
    """Latin letters with marks, in all blocks up to U+024F and in U+1E00 to U+1EFF, and their bare forms; blanks of any
    kind and a plain blank; marks that stand by themselves, which have no counterpart and are dropped."""
    pairs = dict(_SINGLE)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code).lower()
        bare = unicodedata.normalize("NFD", letter)[0]
        if not bare.isascii() and (named := re.match("LATIN SMALL LETTER ([A-Z]) WITH ", unicodedata.name(letter[0], ""))):
            bare = named[1].lower()
        if bare.isascii() and bare.isalpha() and len(letter) == 1 and letter not in SEVERAL:
            pairs[letter] = bare
    pairs |= {chr(code): " " for code in range(0x3001) if chr(code).isspace() and chr(code) != " "}
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


def missing_to_empty(c: Column) -> Column:
    return F.when(c.isNull() | c.isin(*MISSING), "").otherwise(c)


def lower_plain(c: Column) -> Column:
    """Trimmed, lower case, without marks on Latin letters, every kind of blank a plain one."""
    c = F.lower(c)
    for a, b in SEVERAL.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.translate(c, *accent_table()))


def tokens(c: Column) -> Column:
    """Words of a string that is normalised already."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def normalize(c: Column) -> Column:
    """Lower case, plain letters and digits, stop words and one family ending dropped, single blanks."""
    kept = F.filter(F.split(F.regexp_replace(lower_plain(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+"), lambda x: ~x.isin("", *STOP_WORDS))
    return F.trim(F.regexp_replace(F.array_join(kept, " "), f" ({'|'.join(ENDINGS)})$", ""))


def split_name(t: Column) -> Column:
    """first, middle (array) and last of name tokens; a single token is both first and last."""
    n = F.size(t)
    return F.struct(F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"), F.slice(t, 2, F.greatest(n - 2, F.lit(0))).alias("middle"), F.when(n > 0, F.element_at(t, -1)).otherwise("").alias("last"))


def name_slots(t: Column) -> Column:
    """(slot, token) of name tokens, first and last each once, also where they are one token."""
    s = split_name(t)
    slot = lambda name, x: F.struct(F.lit(name).alias("slot"), x.alias("token"))
    return F.when(F.size(t) > 0, F.concat(F.array(slot("first", s["first"])), F.transform(s["middle"], lambda x: slot("middle", x)), F.array(slot("last", s["last"])))).otherwise(F.array().cast("array<struct<slot:string,token:string>>"))


def soundex4(w: Column) -> Column:
    """Soundex of four characters, also for words that begin with a digit; 0000 for the empty word."""
    other = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(F.soundex(F.concat(F.lit("h"), F.substring(w, F.lit(2), F.length(w)))), 2, 3))
    return F.when(w == "", "0000").when(w.rlike("(?i)^[a-z]"), F.soundex(w)).otherwise(other)


def comma(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit("."), F.lit(","))


def two_places(x: Column) -> Column:
    """Two places with a decimal comma, ties of the binary value to even; keeps the sign of zero."""
    return comma(F.format_number(x, 2))


def total_format(x: Column) -> Column:
    """Two places with a decimal comma, ties of the binary value away from zero."""
    return comma(F.when(x * 8 == F.floor(x * 8), F.format_number(F.round(x, 2), 2)).otherwise(F.format_number(x, 2)))


def flag(c: Column) -> Column:
    return F.when(c, "1,0").otherwise("0,0")


def let(value: Column, use) -> Column:
    """Evaluates `value` once for all its uses in use(value)."""
    return F.element_at(F.transform(F.array(value), use), 1)
