"""Small column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions.messages import BANDS


def ntz(value: str) -> Column:
    """Zone-free timestamp literal; the clock of every checked query is a parameter."""
    return F.lit(value).cast("timestamp_ntz")


def hours(n: int | float) -> Column:
    return F.make_dt_interval(hours=F.lit(int(n)))


def last_name_part(qualified: Column) -> Column:
    """``db.schema.Table`` -> ``table``."""
    return F.lower(F.element_at(F.split(qualified, r"\."), -1))


def safe_id(name: Column) -> Column:
    """Dots become underscores."""
    return F.translate(name, ".", "_")


def file_name(name: Column) -> Column:
    """Slashes and blanks become underscores."""
    return F.translate(name, "/ ", "__")


def composite_id(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def first_truthy(*values: Column) -> Column:
    """First value that is neither NULL nor empty, else the last one."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def term_list(terms: Column) -> Column:
    """Map of term -> synonyms rendered as ``term(syn, syn); term(...)``."""
    shown = F.transform(
        F.map_entries(terms),
        lambda e: F.concat(e["key"], F.lit("("), F.array_join(e["value"], ", "), F.lit(")")),
    )
    return F.array_join(shown, "; ")


def marked_list(content: Column, marker: str) -> Column:
    """Blank-free items of the ``|`` list that follows ``marker`` on its line."""
    tail = F.regexp_extract(content, marker + r"([^\n]*)", 1)
    return F.filter(F.transform(F.split(tail, r"\|"), lambda q: F.trim(q)), lambda q: q != "")


def score_band(score: Column) -> Column:
    """Reason text for a relevance score."""
    return (
        F.when(score >= 0.8, BANDS[0])
        .when(score >= 0.6, BANDS[1])
        .when(score >= 0.4, BANDS[2])
        .otherwise(BANDS[3])
    )


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent, NULL where the old value is missing or zero."""
    return F.try_divide(new - old, old) * 100


def signed_percent(rate: Column) -> Column:
    """``+x.x%`` or ``-x.x%``."""
    return F.format_string("%+.1f%%", rate)


def to_korea_time(utc: Column) -> Column:
    """Zone-free UTC timestamp to zone-free Korean local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), utc)


def on_day(ts: Column, day: str) -> Column:
    """True on the calendar day; written as a range so that it reaches the scan."""
    return (ts >= ntz(f"{day} 00:00:00")) & (ts < ntz(f"{day} 00:00:00") + F.make_dt_interval(days=F.lit(1)))


def sample_queries(qualified: Column, primary_key: Column, foreign_keys: Column) -> Column:
    """Example statements for a table: preview, key lookup, joins along two foreign keys."""
    def text(*parts: Column | str) -> Column:
        """Parts as one text, a NULL in it as ``null``."""
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])

    preview = F.array(text("SELECT * FROM ", qualified, " LIMIT 10;"))
    predicate = F.array_join(F.transform(primary_key, lambda c: F.concat(c, F.lit(" = :"), c)), " AND ")
    lookup = F.when(
        F.size(primary_key) > 0,
        F.array(text("SELECT * FROM ", qualified, " WHERE ", predicate, ";")),
    ).otherwise(F.array().cast("array<string>"))
    joins = F.transform(
        F.slice(foreign_keys, 1, 2),
        lambda fk: text(
            "SELECT t.* FROM ", qualified, " t JOIN ", fk["referenced_table"], " r ON t.", fk["column"], " = r.",
            fk["referenced_column"], " LIMIT 10;",
        ),
    )
    return F.concat(preview, lookup, joins)


def filled(text: str, **values: Column) -> Column:
    """Text with its ``{name}`` places filled from columns."""
    parts = [
        values[piece[1:-1]].cast("string") if piece.startswith("{") else F.lit(piece)
        for piece in re.split(r"(\{\w+\})", text)
        if piece
    ]
    return F.concat(*parts)


def number(raw: Column) -> Column:
    """Numeric reading of a result, NULL when it is not a number.

    Suffixes of typed literals, as in ``12d``, are no part of a number.
    """
    text = F.trim(raw.cast("string"))
    return F.when(~text.rlike("[dDfF]$") | text.rlike("(?i)inf$"), text.try_cast("double"))
