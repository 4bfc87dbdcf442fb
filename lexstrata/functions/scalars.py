"""Dates, numbers, arrays, maps and JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, squeeze

DATE = r"(?<![0-9])((?:19|20)[0-9]{2})[.\-/년\s]+([0-9]{1,2})[.\-/월\s]+([0-9]{1,2})일?(?![0-9])"


def parsed_date(x: Column | str) -> Column:
    """The first date in any of the usual notations; null if there is none or it is no day (DAT-1)."""
    y = squeeze(x)
    parts = [F.nullif(F.regexp_extract(y, DATE, k), F.lit("")).cast("int") for k in (1, 2, 3)]
    return F.try_make_date(*parts) if hasattr(F, "try_make_date") else F.expr("try_cast(null as date)")


def date_text(x: Column | str) -> Column:
    """The first date as yyyy-mm-dd, by try_cast (DAT-1, DAT-7)."""
    y = squeeze(x)
    year, month, day = (F.regexp_extract(y, DATE, k) for k in (1, 2, 3))
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "", iso.try_cast("date").cast("string"))


def in_window(x: Column, first: str, last: str) -> Column:
    """Whether an ISO date lies in a window, ends included (DAT-2)."""
    return F.coalesce(x.between(first, last), F.lit(False))


def year_of(x: Column | str) -> Column:
    """First year from 1900 to 2099 in a text (DAT-5)."""
    return F.nullif(F.regexp_extract(F.coalesce(col(x), F.lit("")), r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def five_years(year: Column) -> Column:
    """First year of the five-year period from 2000 on, 2020 at most (DAT-6)."""
    return F.least(year - F.pmod(year - 2000, F.lit(5)), F.lit(2020))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def era(year: Column, bounds: list[int], names: list[str]) -> Column:
    """Name of the range a year falls in: names[i] below bounds[i], the last name from the last bound on (DAT-8)."""
    out = F.lit(names[len(bounds)])
    for b, n in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(year < b, n).otherwise(out)
    return F.coalesce(F.when(year.isNotNull(), out), F.lit("unknown"))


def density(count: Column, total: Column, per: int = 1000) -> Column:
    """Count per `per`, half to even at four places, 0 without a total (MTH-1)."""
    return F.when(total > 0, F.bround(count / total * per, 4)).otherwise(F.lit(0.0))


def first_position(x: Column | str, pattern: str) -> Column:
    """Relative place of the first match, -1 without one (MTH-2)."""
    at = F.regexp_instr(col(x), F.lit(pattern))
    return F.when(at > 0, F.bround((at - 1) / F.greatest(F.length(col(x)), F.lit(1)), 4)).otherwise(F.lit(-1.0))


def effect_label(delta: Column) -> Column:
    """Size of an effect by the usual thresholds (MTH-5)."""
    a = F.abs(delta)
    return F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def unit_interval(key: Column) -> Column:
    """A stable pseudo-random number in [0, 1) from the first 32 bits of a key's SHA-256 (MTH-6)."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296)


def ids_in_order(ids: Column, form: str = "F%03d") -> Column:
    """Whether ids are exactly form(1), form(2), .. (ARR-2)."""
    want = F.transform(F.sequence(F.lit(1), F.size(ids)), lambda i: F.format_string(form, i))
    return F.when(F.size(ids) > 0, ids == want).otherwise(F.lit(True))


def before_or_with(events: Column, harms: Column) -> Column:
    """Whether some event stands no later than some harm: positions of both (ARR-3)."""
    return F.coalesce(F.array_min(events) <= F.array_max(harms), F.lit(False))


def all_and_some(values: Column, test) -> Column:
    """Universal test that fails on an empty array (FLT-9)."""
    return (F.size(values) > 0) & F.forall(values, test)


def same_set(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)).eqNullSafe(F.sort_array(F.array_distinct(b)))


def same_multiset(a: Column, b: Column) -> Column:
    return F.sort_array(a).eqNullSafe(F.sort_array(b))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - intersection / union, 0 for two empty sets (SET-6)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1 - F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence to base 2 of two arrays of counts; an empty one counts as uniform, two as equal (STA-8)."""
    n = F.size(p)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    share = lambda x: F.when(total(x) > 0, F.transform(x, lambda v: v / total(x))).otherwise(F.transform(x, lambda v: F.lit(1.0) / n))
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(share(p), share(q), lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.when((total(p) <= 0) & (total(q) <= 0), F.lit(0.0)).otherwise(total(parts))


def first_seen(values: Column) -> Column:
    """Distinct values in order of first appearance, without nulls and empties (AGG-22)."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def let(values: dict[str, Column], body) -> Column:
    """body of a struct of values, each computed once however often the body names it."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def minimum_target(n: Column) -> Column:
    """max(n + 2, ceil(1.5 n)) (SMP-15)."""
    return F.greatest(n + 2, F.ceil(n * 1.5)).cast("long")


def lookup(entries: Column, key: Column, default: Column) -> Column:
    """Value of a key in a map, or a default (MAP-1)."""
    return F.coalesce(F.try_element_at(entries, key), default)


def inverted(entries: Column) -> Column:
    """Map with keys and values exchanged; of equal values the last key stays, as written again (MAP-1)."""
    swapped = F.transform(F.map_entries(entries), lambda e: F.struct(e["value"], e["key"]))
    last = F.filter(F.transform(swapped, lambda e, i: F.struct(i.alias("i"), e["value"].alias("k"), e["key"].alias("v"))), lambda e: ~F.exists(F.slice(swapped, e["i"] + 2, F.size(swapped)), lambda o: o["value"] == e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
