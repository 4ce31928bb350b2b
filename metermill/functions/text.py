"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_column

# Accented Latin letters and their plain forms, position by position.
ACCENTED = "ÁÀÂÃÄÅáàâãäåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÕÖóòôõöÚÙÛÜúùûüÇçÑñ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNn"

# Texts that stand for a missing territory.
MISSING_TERRITORY = ("", "null", "NULL", "0")


def normalise_name(x) -> Column:
    """No accents, upper case, punctuation to blanks, single blanks."""
    c = F.upper(F.translate(as_column(x), ACCENTED, PLAIN))
    c = F.regexp_replace(c, r"[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(c, r" +", " "))


def blank_to_null(x, missing=MISSING_TERRITORY) -> Column:
    c = F.trim(as_column(x).cast("string"))
    return F.when(c.isin(*missing), None).otherwise(c)


def series_key(*cols) -> Column:
    return F.concat_ws("_", *[as_column(c).cast("string") for c in cols])
