"""Splitting identifiers and paths into words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_words(text: Column) -> Column:
    """Lower-case words of a name or path: camelCase humps, digits kept with letters, all else separates.

    ``parseHTTPRequest_v2`` gives parse, http, request, v2. Empty and null texts give an empty array and null.
    """
    humps = F.regexp_replace(text, r"(\p{Ll}|\p{Nd})(\p{Lu})", "$1 $2")
    humps = F.regexp_replace(humps, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(humps), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
