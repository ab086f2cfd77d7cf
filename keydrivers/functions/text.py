"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what separates the words of a category text.
NOT_ALPHANUMERIC_RUN = "[^a-zA-Z0-9]+"

# How an encoded category is named, as in fuel_type_vec_X.
VECTOR_SUFFIX = "_vec"
VECTOR_INFIX = "_vec_"


def normalized(text: Column | str) -> Column:
    """Lower case, every run of other characters as one dash, no dash at either end.

    Null stays null; a text without any ASCII letter or digit becomes the empty string.
    A run is already replaced by one dash, so no further merging of dashes is needed, and outer
    dashes are trimmed without a second regular expression.
    """
    text = F.col(text) if isinstance(text, str) else text
    dashed = F.regexp_replace(F.lower(F.trim(text)), NOT_ALPHANUMERIC_RUN, "-")
    return F.btrim(dashed, F.lit("-"))


def field_of(slot: Column | str) -> Column:
    """Name of the source column of a feature slot, read from the slot name alone.

    Right unless a source column has the infix in its own name; ``operators.explain`` knows the
    source columns and is right there too.
    """
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.when(
        slot.contains(VECTOR_INFIX), F.substring_index(slot, VECTOR_INFIX, 1)
    ).otherwise(F.regexp_replace(slot, VECTOR_SUFFIX + "$", ""))
