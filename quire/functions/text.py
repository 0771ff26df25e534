"""Column expressions over text: white space, names, paths, sort keys and correction rules."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_RANK = 10_000


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """White-space tokens; a blank text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def present(text: Column) -> Column:
    """Is there anything but white space, Unicode's included?"""
    return strip(F.coalesce(text, F.lit(""))) != ""


def wrapped(text: Column, width: int = 80) -> Column:
    """array<string>: the text's display lines of at most ``width`` characters, broken at white space and hyphens."""

    @F.pandas_udf("array<string>")
    def wrap(texts: pd.Series) -> pd.Series:
        return pd.Series([textwrap.wrap(t or "", width) for t in texts], dtype=object)

    return wrap(text)


def slug(text: Column) -> Column:
    """Lower-case identifier of a-z, 0-9, ``_`` and ``-``; ``unknown`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", "_"), "[^a-z0-9_-]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("unknown"))


def file_safe(text: Column) -> Column:
    """Runs of anything but letters and digits as ``_``, none at the ends."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def group_of(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def same_path(path: Column) -> Column:
    """A path without empty authority, as file systems list it: ``file:/a`` for ``file:///a``."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):///+", "$1:/")


def plain_path(uri: Column) -> Column:
    """The path that a URI stands for: ``%20`` and its like decoded, a plus sign left as it is."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def padded_name(page: Column, number: Column, suffix: str = ".png") -> Column:
    """``page_line_007.png``."""
    return F.concat(page, F.format_string("_line_%03d", number), F.lit(suffix))


def natural_key(text: Column) -> Column:
    """A string that sorts as the text does with its digit runs, however long, read as numbers, case ignored."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(p: Column) -> Column:
        bare = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(bare).cast("string"), 9, "0"), bare)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def page_number(page: Column) -> Column:
    """Leading number of page tokens such as ``12`` and ``3left``."""
    return F.coalesce(group_of(page, r"^(\d+)[A-Za-z]*$").cast("int"), F.lit(NO_RANK))


def side_rank(page: Column) -> Column:
    """0 for no side, 1 left, 2 right, 3 anything else."""
    side = F.when(page.rlike(r"^\d+[A-Za-z]*$"), F.lower(F.regexp_extract(page, r"^\d+([A-Za-z]*)$", 1))).otherwise(F.lower(page))
    return F.when(side == "", 0).when(side == "left", 1).when(side == "right", 2).otherwise(3)


def corrected(text: Column) -> Column:
    """The fixed rules of spelling correction that need no model: c-cedilla to z, a q that stands alone to ``que``."""
    return F.regexp_replace(F.translate(text, "çÇ", "zZ"), r"(?<![\p{L}\p{N}_])q(?![\p{L}\p{N}_])", "que")


#: spellings that an evaluation may take as equal: u and v, f and s, c-cedilla and z, accents other than that of n
ALIKE = ("vVfFçÇáàâäéèêëíìîïóòôöúùûüÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "uUsSzZaaaaeeeeiiiioooouuuuAAAAEEEEIIIIOOOOUUUU")


def evaluation_form(text: Column) -> Column:
    """Text with spellings that count as equal made equal, without a hyphen at its end."""
    return F.regexp_replace(F.translate(text, *ALIKE), "-+$", "")
