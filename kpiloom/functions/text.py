"""Text normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text that a raw file may hold in place of a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
# A private-use character and a space; the space is what `initcap` looks for.
_WORD_MARK = "\ue000 "


def null_if_missing(text: Column) -> Column:
    """NULL for the tokens that stand for a missing value, else the text."""
    return F.when(~text.isin(*MISSING_TOKENS), text)


def trim_text(text: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` alone strips spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def title_case(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others.

    ``initcap`` starts a word only after a space, so each other word start is
    marked with one before the call and unmarked after it.
    """
    marked = F.regexp_replace(text, f"(?<!{_CASED})(?={_CASED})", _WORD_MARK)
    return F.replace(F.initcap(marked), F.lit(_WORD_MARK), F.lit(""))


def digits_only(text: Column) -> Column:
    """Remove everything but digits, of any script."""
    return F.regexp_replace(text, r"\P{Nd}+", "")
