"""Typed rows and rejected lines of delimited text files.

Structure (quoting, number of fields) is checked on each line. Values are checked in a
dictionary: each distinct value of a judged column is cast once, and only the invalid ones,
with their reason, are joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quoted field at the start of a line or after a comma. All repeats are possessive, so long lines cost linear time and no stack.
_QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)'
_FIELD = r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,"]*+)'
_MARK = "\x01"
_US_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_NUMBER = r"^[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$"
_GROUPED = r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})++(?:\.[0-9]*+)?(?:[eE][+-]?[0-9]++)?$"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s++|\s++$", "")


def unquote(x: Column) -> Column:
    """The content of a field: enclosing quotes removed, doubled quotes single."""
    inside = F.regexp_replace(F.regexp_replace(x, r'^"|"$', ""), '""', '"')
    return F.when(x.startswith('"'), inside).otherwise(x)


def parse_date(x: Column) -> Column:
    """A real calendar date written month/day/year or YYYY-MM-DD, else null."""
    text = _strip(unquote(x))
    american = F.when(text.rlike(_US_DATE), F.try_to_date(text, "M/d/yyyy"))
    return F.coalesce(american, F.when(text.rlike(_ISO_DATE), F.try_to_date(text, "yyyy-MM-dd")))


def parse_number(x: Column) -> Column:
    """A finite decimal number; commas may group its integer part by threes inside quotes. Else null."""
    text = _strip(unquote(x))
    plain = F.when(text.rlike(_NUMBER), text).when(x.startswith('"') & text.rlike(_GROUPED), F.replace(text, F.lit(","), F.lit("")))
    value = plain.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


PARSERS = {"date": parse_date, "number": parse_number}


def split_lines(lines: DataFrame, *, file: str = "file_name", line_no: str = "line_no", line_id: str = "line_id", text: str = "raw_line") -> DataFrame:
    """Data lines with ``fields``, the header of their file (lower case, trimmed) and the structural reason, if any."""
    base = lines.select(F.col(line_id).alias("line_id"), F.col(file).alias("file_name"), F.col(line_no).alias("line_no"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r$", "").alias("_line"))
    first = F.min(F.struct("line_id", "_line"))["_line"]
    names = F.transform(F.split(F.regexp_replace(first, "^﻿", ""), ",", -1), lambda c: F.lower(F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    headers = base.where(F.col("line_no") == 1).groupBy(F.col("file_name").alias("_file")).agg(names.alias("header"))
    data = base.where(F.col("line_no").isNull() | (F.col("line_no") != 1))
    quoted = F.contains(F.col("_line"), F.lit('"'))
    masked = F.when(quoted, F.regexp_replace("_line", _QUOTED, f"$1{_MARK}")).otherwise(F.col("_line"))
    data = data.withColumn("_masked", masked).withColumn("_count", F.length("_masked") - F.length(F.replace("_masked", F.lit(","), F.lit(""))) + 1)
    data = data.join(headers, F.col("file_name").eqNullSafe(F.col("_file")), "left")
    broken = F.contains(F.col("_masked"), F.lit('"'))
    miscounted = F.col("header").isNull() | (F.col("_count") != F.size("header")) | (F.length(F.trim("_line")) == 0)
    fields = F.when(quoted, F.regexp_extract_all("_line", F.lit(_FIELD), F.lit(1))).otherwise(F.split("_line", ",", -1))
    reason = F.when(broken, F.lit("quote")).when(miscounted, F.lit("columns"))
    return data.select("line_id", "file_name", "line_no", "header", reason.alias("structure"), F.when(reason.isNull(), fields).alias("fields"))


def read_lines(lines: DataFrame, judged: Mapping[str, str] | Sequence[tuple[str, str]], *, file: str = "file_name", line_no: str = "line_no", line_id: str = "line_id", text: str = "raw_line") -> DataFrame:
    """Every data line, judged alone: ``line_id, file_name, line_no, header, fields, reason``.

    judged: header name -> kind (``date`` or ``number``), in the order in which reasons rank.
    reason is null for a valid line, else the first of ``quote`` (a double quote that does not
    enclose a whole field, or is never closed), ``columns`` (not as many fields as the header;
    blank lines; a file without a header line) and the names of the judged columns whose value
    is invalid. A carriage return at the end does not count. A judged column the header lacks
    is invalid in every line. A null line counts as blank, a null line number as data, a null
    file name as a file. Columns other than the judged ones are not looked at.
    """
    judged = dict(judged)
    split = split_lines(lines, file=file, line_no=line_no, line_id=line_id, text=text)
    value = lambda name: F.try_element_at(F.col("fields"), F.nullif(F.array_position("header", name), F.lit(0)).cast("int"))
    split = split.withColumns({f"_in_{name}": F.when(F.col("structure").isNull(), F.coalesce(value(name), F.lit(""))) for name in judged})
    distinct = (
        split.where(F.col("structure").isNull())
        .select(F.inline(F.array(*[F.struct(F.lit(name).alias("_column"), F.col(f"_in_{name}").alias("_text")) for name in judged])))
        .groupBy("_column", "_text")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    valid = F.lit(False)
    for name, kind in judged.items():
        valid = valid | ((F.col("_column") == name) & PARSERS[kind](F.col("_text")).isNotNull())
    invalid = distinct.where(~valid)
    out = split
    for name in judged:
        entry = invalid.where(F.col("_column") == name).select(F.col("_text").alias(f"_bad_{name}"), F.col("_column").alias(f"_reason_{name}"))
        out = out.join(entry, F.col(f"_in_{name}") == F.col(f"_bad_{name}"), "left")
    reason = F.coalesce(F.col("structure"), *[F.col(f"_reason_{name}") for name in judged])
    return out.select("line_id", "file_name", "line_no", "header", "fields", reason.alias("reason"))


def typed_rows(read: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The valid lines of :func:`read_lines` with ``columns`` (header name -> kind) typed, and ``invalid``.

    Only the named fields are parsed, each by its own kind. A value that does not parse, or of a column the header
    lacks, is null; ``invalid`` names the columns whose field holds something that does not parse, in the order
    given, so that what is lost beside the judged columns is reported too.
    """
    field = lambda name: F.try_element_at("fields", F.nullif(F.array_position("header", name), F.lit(0)).cast("int"))
    picked = read.where(F.col("reason").isNull()).select("line_id", "file_name", "line_no", *[field(name).alias(f"_in_{name}") for name in columns])
    parsed = picked.select("line_id", "file_name", "line_no", *[f"_in_{name}" for name in columns], *[PARSERS[kind](F.col(f"_in_{name}")).alias(name) for name, kind in columns.items()])
    lost = [F.when(F.col(name).isNull() & (_strip(F.col(f"_in_{name}")) != ""), F.lit(name)) for name in columns]
    return parsed.select("line_id", "file_name", "line_no", *columns, F.array_compact(F.array(*lost)).alias("invalid"))
