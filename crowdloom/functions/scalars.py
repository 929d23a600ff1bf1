"""Column expressions for names, times, dates and bands; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_FIRST, BIN_MINUTES, N_BINS = 330, 30, 39


def canonical_name(name: Column, forced: dict[str, str] | None = None, keep_suffix: tuple[str, ...] = (), suffix: str = "역", greedy: bool = False, drop_direction: bool = False) -> Column:
    """Blanks out, a forced map, a trailing parenthesis off, then a suffix unless exempt."""
    bare = F.regexp_replace(name, r"\s+", "")
    cut = F.regexp_replace(bare, r"\(.*\)$" if greedy else r"\([^()]*\)$", "")
    if drop_direction:
        cut = F.regexp_replace(cut, "[ES]$", "")
    off = F.regexp_replace(cut, f"(?<=.){suffix}$", "")
    out = F.when(cut.isin(*keep_suffix), cut).otherwise(off) if keep_suffix else off
    for raw, to in (forced or {}).items():
        out = F.when(bare == raw, to).otherwise(out)
    return out


def canonical_list(raw: Column, sep: str = ";", **how: object) -> Column:
    parts = F.filter(F.transform(F.split(raw, sep), lambda x: canonical_name(x, **how)), lambda x: x != "")
    return F.array_join(parts, sep)


def header_minutes(header: Column) -> Column:
    """5시30분, 05:30~06:00 or 00시 as minutes of the service day; hours before 5 are the next day's."""
    m = r"^\s*(\d{1,2})\s*[시:]\s*(\d{2})?"
    hour = F.try_to_number(F.nullif(F.regexp_extract(header, m, 1), F.lit("")), F.lit("99")).cast("int")
    minute = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(header, m, 2), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    return F.when(hour < 5, hour + 24).otherwise(hour) * 60 + minute


def mmss_minutes(text: Column) -> Column:
    good = text.rlike(r"^\s*\d+:[0-5]\d\s*$")
    return F.when(good, F.split_part(F.trim(text), F.lit(":"), F.lit(1)).try_cast("double") + F.split_part(F.trim(text), F.lit(":"), F.lit(2)).try_cast("double") / 60)


def time_bin(minutes: Column) -> Column:
    """Half-hour bin 0..38 of a service-day minute, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(N_BINS - 1), F.floor((minutes - HOUR_FIRST) / BIN_MINUTES))).cast("int")


def bin_label(index: Column) -> Column:
    a = index * BIN_MINUTES + HOUR_FIRST
    clock = lambda m: F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))
    return F.concat(clock(a), F.lit("~"), clock(a + BIN_MINUTES))


def hour_code(minutes: Column) -> Column:
    return F.when(minutes < 360, "before_06").when(minutes >= 1440, "after_24").otherwise(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"))


def day_type(date: Column) -> Column:
    day = F.weekday(date)
    return F.when(day < 5, "weekday").when(day == 5, "sat").otherwise("sun")


def clean_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[,\s]", "").try_cast("double")


def clean_date(text: Column, nulls: tuple[str, ...] = ("", "-", "nan", "NaT", "None")) -> Column:
    bare = F.trim(text)
    return F.when(~bare.isin(*nulls), F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")), F.try_to_timestamp(bare, F.lit("yyyyMMdd"))).cast("date"))


def hour_list(text: Column, fold: int = 24, before: int = 5, add: bool = False) -> Column:
    """Hours of an `a;b;c` list; those before `before` become fold, or gain 24 (add)."""
    hours = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x).try_cast("int")), lambda h: h.isNotNull())
    folded = F.transform(hours, lambda h: F.when(h < before, h + 24 if add else F.lit(fold)).otherwise(h))
    return F.array_distinct(folded)


def node_id(line: Column, station: Column, branch: Column | None = None) -> Column:
    base = F.concat(line.cast("string"), F.lit("_"), station)
    return base if branch is None else F.concat(base, F.when(branch.isNotNull(), F.concat(F.lit("@"), branch)).otherwise(""))


def node_line(node: Column) -> Column:
    return F.substring_index(node, "_", 1)


def node_station(node: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(node, "^[^_]*_", ""), "@[^@]*$", "")


def range_parts(text: Column) -> tuple[Column, Column, Column]:
    """Start, end and days of `a~b`; a single date is its own end."""
    a = clean_date(F.split_part(text, F.lit("~"), F.lit(1)))
    b = F.coalesce(clean_date(F.split_part(text, F.lit("~"), F.lit(2))), a)
    return a, b, F.datediff(b, a) + 1


def title_year_first(title: Column) -> Column:
    year = F.regexp_extract(title, r"(\b\d{4}\b)", 1)
    rest = F.regexp_replace(title, r"\b\d{4}\b", " ")
    return F.trim(F.regexp_replace(F.concat_ws(" ", F.nullif(year, F.lit("")), rest), r"\s+", " "))


def perceived_multiplier(rate: Column, kappa: float = 0.5, floor: float = 80.0) -> Column:
    return F.when(rate.isNotNull(), 1 + kappa * F.greatest(rate - floor, F.lit(0.0)) / 100)


def band(value: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed bands: the first name up to and with the first edge."""
    out = F.when(value.isNull(), None)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(value <= edge, name)
    return out.otherwise(names[-1])


def strength(ratio: Column, edges: tuple[float, ...] = (1.2, 1.5, 2.0, 3.0), names: tuple[str, ...] = ("not_significant", "weak", "medium", "strong", "very_strong")) -> Column:
    out = F.when(ratio.isNull(), None)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(ratio < edge, name)
    return out.otherwise(names[-1])


def expected_wait(departures: Column, minutes: float = 30.0, low: float = 0.1, high: float = 60.0) -> Column:
    headway = F.lit(minutes) / F.nullif(departures, F.lit(0))
    return F.when(headway.between(low, high), headway / 2)


def toward(text: Column) -> Column:
    """A direction text without its direction word and station suffix."""
    bare = F.trim(F.regexp_replace(text, r"\s*방면\s*$", ""))
    return F.when(F.length(bare) > 2, F.regexp_replace(bare, "역$", "")).otherwise(bare)


def valid_toward(station: Column, text: Column) -> Column:
    """False where a direction is missing or names the station itself."""
    return F.coalesce((F.trim(F.coalesce(text, F.lit(""))) != "") & (toward(text) != toward(station)), F.lit(False))
