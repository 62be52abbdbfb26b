"""Spellings that mean the same: papers, places, labels, confidences. Column functions, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data: how a paper is spelled.
STEM = r"^(?:(?:[0-9]+|pbank)_)*([0-9]{4}_[0-9]{6})(?:_?v[0-9]+)?$"
LOCAL_FRONT = r"^(?:[0-9]+_)?(?:pbank_)?([a-z].*)$"
VERSION = r"([0-9])_?v[0-9]+$"
BLANKS = " \t\r\n"
NUMBER = r"^([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)\s*(%?)$"


def paper(col: Column | str) -> Column:
    """Key of the paper that a doc id names; null where it names none (null, empty or blank).

    The stem ``dddd_dddddd`` without ordinal, mark and version; else the name in lower case with one kind of
    separator, without those. Nothing else is ignored.
    """
    c = F.col(col) if isinstance(col, str) else col
    flat = F.translate(F.lower(c), "-.", "__")
    stem = F.regexp_extract(flat, STEM, 1)
    bare = F.regexp_replace(flat, VERSION, "$1")
    local = F.regexp_extract(bare, LOCAL_FRONT, 1)
    return F.when(F.btrim(c, F.lit(BLANKS)) != "", F.when(stem != "", stem).when(local != "", local).otherwise(bare))


def paper_sql(c: str) -> str:
    flat = f"translate(lower({c}), '-.', '__')"
    bare = rf"regexp_replace({flat}, '{VERSION}', '\1')"
    return (
        f"CASE WHEN trim({c}, E' \\t\\r\\n') <> '' THEN coalesce(nullif(regexp_extract({flat}, '{STEM}', 1), ''), "
        f"nullif(regexp_extract({bare}, '{LOCAL_FRONT}', 1), ''), {bare}) END"
    )


def place(col: Column | str) -> Column:
    """Key of the place that a path names; null for a null or blank path. Letter case counts."""
    c = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))
    one = F.regexp_replace(F.concat(F.lit("/"), c, F.lit("/")), r"(?:[/\\]+(?:\.(?=[/\\]))?)+", "/")
    return F.when(c != "", F.btrim(one, F.lit("/")))


def place_sql(c: str) -> str:
    parts = f"list_filter(string_split(replace(trim({c}, E' \\t\\r\\n'), '\\', '/'), '/'), lambda x: x <> '' AND x <> '.')"
    return f"CASE WHEN trim({c}, E' \\t\\r\\n') <> '' THEN array_to_string({parts}, '/') END"


def label(col: Column | str) -> Column:
    """A label in lower case with ``_`` between words; null for null, blank and ``unknown``."""
    c = F.col(col) if isinstance(col, str) else col
    flat = F.regexp_replace(F.lower(F.btrim(c, F.lit(BLANKS))), r"[_\-\s]+", "_")
    return F.when(~flat.isin("", "unknown"), flat)


def label_sql(c: str) -> str:
    return rf"nullif(nullif(regexp_replace(lower(trim({c}, E' \t\r\n')), '[_\-\s]+', '_', 'g'), ''), 'unknown')"


def confidence(col: Column | str) -> Column:
    """The number from 0 to 1 that is written, per cent and decimal comma included, as an exact decimal; else null."""
    c = F.translate(F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))), ",", ".")
    digits, cent = F.regexp_extract(c, NUMBER, 1), F.regexp_extract(c, NUMBER, 2) == "%"
    plain = digits.try_cast("decimal(36,20)")
    shifted = F.when(digits.contains("e"), (plain * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(36,20)")).otherwise(F.concat(digits, F.lit("e-2")).try_cast("decimal(36,20)"))
    value = F.when(cent, shifted).otherwise(plain)
    return F.when(value.between(0, 1), value)


def confidence_sql(c: str) -> str:
    flat = f"translate(lower(trim({c}, E' \\t\\r\\n')), ',', '.')"
    digits, cent = f"regexp_extract({flat}, '{NUMBER}', 1)", f"regexp_extract({flat}, '{NUMBER}', 2)"
    value = f"try_cast({digits} || CASE WHEN {cent} = '%' THEN 'e-2' ELSE '' END AS DECIMAL(36,20))"
    return f"CASE WHEN {value} BETWEEN 0 AND 1 THEN {value} END"
