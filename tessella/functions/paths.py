"""Path and label clean-up as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    r"""``\`` reads as ``/``, then one leading ``./`` is dropped. Case is kept, null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def clean_label(label: Column) -> Column:
    """Surrounding white space dropped, upper case. Null stays null."""
    return F.upper(F.regexp_replace(label, r"^[\s ]+|[\s ]+$", ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)
