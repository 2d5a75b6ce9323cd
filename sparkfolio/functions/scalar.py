"""Scalar functions as Column expressions: hashes, vectors, places, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside array functions, where Spark shares no subexpressions."""
    return F.transform(F.array(value), body)[0]


def signed_bits(unsigned: Column) -> Column:
    """A decimal that holds an unsigned 64-bit number, as the long of the same bits."""
    wide = unsigned.cast("decimal(20,0)")
    half, whole = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(wide >= half, wide - whole).otherwise(wide).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def l2(a: Column, b: Column) -> Column:
    """Distance of two vectors in doubles; null if their lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def l2_shorter(a: Column, b: Column) -> Column:
    """Distance over the places that both vectors have."""
    n = F.least(F.size(a), F.size(b))
    return l2(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared over all members of two arrays as sets; ``both_empty`` where there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(both_empty))


def tag_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard, and 0.5 where neither side has a tag."""
    return F.when(F.size(F.array_union(a, b)) > 0, 1 - jaccard(a, b)).otherwise(F.lit(0.5))


def valid_place(lat: Column, lon: Column) -> Column:
    """Whether a place is finite, in range and not exactly (0, 0)."""
    inside = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(inside & ~((lat == 0) & (lon == 0)), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two places."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def cell(degrees: Column, per_degree: int = 100) -> Column:
    """The rounded grid cell of a coordinate."""
    return F.round(degrees * per_degree).cast("int")


def instant(captured: Column, offset: Column) -> Column:
    """A wall clock as an instant; an unknown offset counts as none."""
    return captured - F.coalesce(offset, F.lit(0))


def offset_seconds(text: Column) -> Column:
    """Seconds of a strict ``+HH:MM`` (hours to 14, minutes under 60), else null."""
    pattern = r"^([+-])([0-9]{2}):([0-9]{2})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    hours, minutes = part(2).try_cast("int"), part(3).try_cast("int")
    value = (hours * 3600 + minutes * 60) * F.when(part(1) == "-", -1).otherwise(1)
    return F.when(text.rlike(pattern) & (hours <= 14) & (minutes < 60), value)


def day_number(seconds: Column) -> Column:
    """The day of an epoch second, also before 1970."""
    return F.floor(seconds / 86400)


def date_range(low: Column, high: Column) -> Column:
    """A short label of the days from one timestamp to another, either way round: ``12 Mar 2026``, ``3-9 Mar 2026``, ``28 Feb - 2 Mar 2026`` or with both years."""
    a, b = F.least(low, high), F.greatest(low, high)
    day, month, year = (lambda t: F.date_format(t, "d")), (lambda t: F.date_format(t, "MMM")), (lambda t: F.date_format(t, "yyyy"))
    full = lambda t: F.concat_ws(" ", day(t), month(t), year(t))
    same_year, same_month = year(a) == year(b), month(a) == month(b)
    return (
        F.when(low.isNull() | high.isNull(), F.lit(None).cast("string"))
        .when(F.to_date(a) == F.to_date(b), full(a))
        .when(same_year & same_month, F.concat(day(a), F.lit("-"), full(b)))
        .when(same_year, F.concat(day(a), F.lit(" "), month(a), F.lit(" - "), full(b)))
        .otherwise(F.concat(full(a), F.lit(" - "), full(b)))
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def base_name(path: Column) -> Column:
    """The last part of a path, whatever slashes follow it."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_name(page: Column, z: Column, digest: Column) -> Column:
    """``p07-z1-`` and the first 8 characters of a digest."""
    return F.concat(F.lit("p"), F.when(page < 10, F.lit("0")).otherwise(F.lit("")), page.cast("string"), F.lit("-z"), z.cast("string"), F.lit("-"), F.substring(digest, 1, 8))


def failure_key(size: Column, modified: Column) -> Column:
    return F.concat_ws(":", F.lit("stamp"), size.cast("string"), modified.cast("string"))


def byte_label(n: Column) -> Column:
    """A size in GB, MB or KB."""
    unit = lambda div, digits, name: F.concat(F.format_number(n / div, digits), F.lit(f" {name}"))
    return F.when(n >= 1e9, unit(1e9, 1, "GB")).when(n >= 1e6, unit(1e6, 0, "MB")).otherwise(unit(1e3, 0, "KB"))


def words(text: Column) -> Column:
    """Lower-case words: what lies between characters that are no letter or digit."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    part = lambda x: F.lpad(F.lower(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def first_name(*names: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def page_count(n: Column) -> Column:
    """At least 20, even, null over 150."""
    even = F.greatest(F.lit(20), n + F.pmod(n, F.lit(2)))
    return F.when(even <= 150, even)
