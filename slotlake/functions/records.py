"""Delimited records: splitting one record text into cells."""

from __future__ import annotations

import re

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F


def delimiter_of(path: str) -> str:
    """Tab for `.tsv` (any case), else comma."""
    return "\t" if path.lower().endswith(".tsv") else ","


def _quoted(sep: str) -> str:
    """A quoted field, quotes included. A quote that is neither doubled nor followed
    by a separator or the end is part of the text."""
    s = re.escape(sep)
    return rf'"[^"]*+(?:(?:""|"(?!{s}|\z|"))[^"]*+)*+"(?={s}|\z)'


def _plain(sep: str) -> str:
    return rf'(?!")[^{re.escape(sep)}]*+'


def is_closed(line: SparkColumn, sep: str) -> SparkColumn:
    """True if no quoted field of this line runs on into the next line."""
    s = re.escape(sep)
    whole = rf"^(?:{s}(?:{_quoted(sep)}|{_plain(sep)}))*+\z"
    return F.when(
        line.contains('"'), F.concat(F.lit(sep), line).rlike(whole)
    ).otherwise(F.lit(True))


def split_record(record: SparkColumn, sep: str) -> SparkColumn:
    """Cells of one record. Records without a quote take the plain split."""
    s = re.escape(sep)
    # The separator is put in front, so that every field match has some text.
    field = rf'{s}({_quoted(sep)}|{_plain(sep)}|"[^{s}]*+)'
    fields = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(field), F.lit(1))
    bare = F.transform(
        fields,
        lambda f: F.when(
            f.startswith('"'),
            F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(f),
    )
    return F.when(record.contains('"'), bare).otherwise(split_plain(record, sep))


def split_plain(record: SparkColumn, sep: str) -> SparkColumn:
    """Cells of a record without any quoting rule."""
    return F.split(record, re.escape(sep), -1)
