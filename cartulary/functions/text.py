"""Text columns: comparison keys, character repair, names and labels.

Each function takes and gives columns, and stays within built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a spreadsheet shows for an absent value.
ABSENT = ("NAN", "NONE", "NULL")
LETTERS = "A-ZÁÉÍÓÚÜÑ"
#: Accented Latin capitals and the plain letters that they fold to.
ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇÝŸ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYY"
#: Synthetic label words; callers pass the stop words of their own forms.
NAME_STOP_WORDS = ("NAME", "NAMES", "SURNAME", "SURNAMES", "SIGNATURE", "HOLDER", "DOCUMENT", "NUMBER", "DATE", "PLACE", "SEX", "REPUBLIC", "CIVIL", "REGISTER")
PLACE_STOP_WORDS = ("PLACE", "DATE", "ISSUE", "ISSUED", "REPUBLIC", "NATIONAL", "PERSONAL", "NUMBER", "DOCUMENT", "REGISTER", "CIVIL", "SIGNATURE")
PARTICLES = ("DE", "DEL", "LA", "EL", "LOS", "LAS")


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after another."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comparison_key(value: Column) -> Column:
    """Equal for values that differ only in case, outer and inner space, or the accents of A E I O U; never null.

    Placeholders for an absent value count as empty; they are looked for before accents are folded.
    """
    upper = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(upper.isin(*ABSENT), F.lit("")).otherwise(squeeze(F.translate(upper, "ÁÉÍÓÚÜ", "AEIOUU")))


def sheet_text(value: Column) -> Column:
    """A spreadsheet cell: trimmed, upper case, empty if null or shown as NAN."""
    upper = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(upper == "NAN", F.lit("")).otherwise(upper)


def without_accents(value: Column) -> Column:
    """Upper case with all Latin accents folded (also Ñ to N, other than in comparison_key)."""
    return F.translate(F.upper(value), ACCENTED, PLAIN)


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), where value is worked out once however often the rule names it: in an array of one."""
    return F.transform(F.array(value), rule)[0]


def repair_name(value: Column) -> Column:
    """Characters that recognition confuses within names: five rewrites, in this order."""
    return chain(
        F.upper(value),
        (rf"([{LETTERS}]{{2,}})[!1|\]]", "$1I"),
        (rf"([{LETTERS}]+)0([{LETTERS}]+)", "$1O$2"),
        (rf"([{LETTERS}]+)1([{LETTERS}]+)", "$1I$2"),
        (rf"([{LETTERS}]{{2,}})0(?![{LETTERS}0-9_])", "$1O"),
        (rf"([{LETTERS}]{{2,}})5(?![{LETTERS}0-9_])", "$1S"),
    )


def person_name(value: Column, stop_words: Sequence[str] = NAME_STOP_WORDS) -> Column:
    """A clean name: repaired, letters and hyphens only, no stop word or single letter, at most five words; else null."""
    letters = F.upper(F.regexp_replace(repair_name(value), rf"[^{LETTERS}\s\-]", ""))
    stop = rf"^({'|'.join(stop_words)})(?![{LETTERS}0-9_])"
    words = F.filter(F.split(squeeze(letters), " "), lambda w: (F.length(w) > 1) & ~w.rlike(stop))
    return once(F.array_join(F.slice(words, 1, 5), " "), lambda name: F.when((F.length(name) >= 3) & ~name.isin(*PARTICLES), name))


def label_name(value: Column, stop_words: Sequence[str] = NAME_STOP_WORDS) -> Column:
    """A name read next to a label: ! and 1 as I, words of two letters or more that are no header, then person_name."""
    letters = F.regexp_replace(F.upper(F.translate(value, "!1", "II")), rf"[^{LETTERS}\s]", "")
    words = F.filter(F.split(squeeze(letters), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words, *PARTICLES))
    return once(F.array_join(words, " "), lambda joined: F.when(F.length(joined) >= 3, person_name(joined, stop_words)))


#: Characters that recognition takes for digits, and the digits; the last one, a space, has none and goes.
TAKEN_FOR_DIGITS, DIGITS = "OoQDlIi|!BbSsZzGgqAT ", "00001111188552266947"


def repair_digits(value: Column) -> Column:
    """Letters that recognition takes for digits, as digits; spaces go."""
    return F.translate(value, TAKEN_FOR_DIGITS, DIGITS)


def word_key(value: Column) -> Column:
    """A word for dictionary look-up: digits inside words as letters, accents folded, letters (with Ñ) and spaces only."""
    upper = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    inside = [(rf"(?<=[A-Z]){digit}(?=[A-Z]|$)", letter) for digit, letter in zip("01245", "OIZAS", strict=True)]
    folded = F.translate(chain(upper, *inside), "ÁÀÄÂÉÈËÊÍÌÏÎÓÒÖÔÚÙÜÛ", "AAAAEEEEIIIIOOOOUUUU")
    return squeeze(F.regexp_replace(folded, r"[^A-ZÑ\s]", ""))


def tidy_text(value: Column, glued_labels: Sequence[str] = ("SURNAMES", "NAMES", "NUMBER", "SEX")) -> Column:
    """Upper-case page text: a value glued to its label is set apart, spaces and line breaks collapse."""
    apart = chain(F.upper(value), *[(rf"\b({label})(?=[A-Z0-9])(?!S\b)", "$1 ") for label in glued_labels])
    return F.trim(chain(apart, (r"[ \t]+", " "), (r"\n{2,}", "\n")))


def full_name(given: Column, surnames: Column) -> Column:
    return F.concat_ws(" ", given, surnames)


def is_text_line(line: Column, stop_words: Sequence[str] = NAME_STOP_WORDS) -> Column:
    """A line that can be a name: no digit, one to five words of two letters or more that are no label.

    Letters count as written: a lone ß is one letter, though two in upper case.
    """
    words = F.filter(F.split(squeeze(line), " "), lambda w: (F.length(w) >= 2) & ~F.upper(w).isin(*stop_words))
    return ~line.rlike("[0-9]") & F.size(words).between(1, 5) & (F.length(F.trim(line)) >= 3)


def duplicate_words(words: Column) -> Column:
    """struct<duplicated, kept>: whether a word repeats by its key, and the first of each."""
    def found(s: Column) -> Column:
        # the first of each key comes after another key; sorting, unlike a search per word, suits long texts
        first = F.filter(s, lambda x, i: x["key"].isNotNull() & ((i == 0) | ~x["key"].eqNullSafe(F.get(s, i - 1)["key"])))
        kept = F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word")))), lambda x: x["word"])
        return F.struct((F.size(F.array_distinct(F.transform(s, lambda x: x["key"]))) < F.size(s)).alias("duplicated"), kept.alias("kept"))

    keyed = F.transform(words, lambda w, i: F.struct(word_key(w).alias("key"), i.alias("at"), w.alias("word")))
    # in an array of one, so that the keys are made once for all words
    return F.transform(F.array(F.array_sort(keyed)), found)[0]


def needs_recognition(text: Column) -> Column:
    """Blank text, fewer than five runs of three letters or digits, or under 50 characters after collapsing space."""
    body = F.coalesce(text, F.lit(""))
    runs = F.size(F.regexp_extract_all(body, F.lit("([A-Za-z0-9]{3,})"), F.lit(1)))
    return (F.trim(body) == "") | (runs < 5) | (F.length(squeeze(body)) < 50)


def display_confidence(value: Column) -> Column:
    """A confidence as a whole percentage: values up to 1 are fractions; within 0 and 100."""
    return F.round(F.least(F.greatest(F.when(value <= 1, value * 100).otherwise(value), F.lit(0.0)), F.lit(100.0)))


def byte_size(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
