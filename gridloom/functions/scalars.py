"""Column functions: spectral and terrain indices, calendars, geography, parsing and scaling. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 1e-8
YEAR_DAYS = 365.2425


# --- spectral -------------------------------------------------------------------------------------


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red + F.lit(EPSILON))


def evi(nir: Column, red: Column, blue: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, soil: float = 1.0) -> Column:
    return F.try_divide(F.lit(gain) * (nir - red), nir + F.lit(c1) * red - F.lit(c2) * blue + F.lit(soil))


def finite(c: Column) -> Column:
    """The value, null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def guarded_ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null unless both are positive and finite."""
    a, b = finite(a), finite(b)
    return F.when((a > 0) & (b > 0), (a - b) / (a + b))


def reflectance(dn: Column, scale: float = 10_000.0) -> Column:
    return dn.cast("double") / F.lit(scale)


def harmonised(dn: Column, baseline: Column, applied: Column, offset: int = 1000) -> Column:
    """Take off the radiometric offset that processing baselines from 4 on add, unless it was taken off already."""
    return F.when((baseline >= 4) & ~applied, F.greatest(F.lit(0), dn - F.lit(offset))).otherwise(dn)


def with_indices(pixels: DataFrame, nir: str = "nir", red: str = "red", blue: str = "blue") -> DataFrame:
    """`pixels` plus ndvi and evi."""
    return pixels.withColumns({"ndvi": ndvi(F.col(nir), F.col(red)), "evi": evi(F.col(nir), F.col(red), F.col(blue))})


def sar_normalised(df: DataFrame, value: str, group: list[str], out: str = "sar") -> DataFrame:
    """log1p of the clamped value over the group's 99th percentile, clipped to [0, 1].

    A group of which over half of the finite non-zero values are negative looks like decibels and is refused; a group with
    a non-finite value is divided by 1.
    """
    v = F.col(value).cast("double")
    ok = finite(v).isNotNull()
    stats = df.groupBy(*group).agg(
        F.expr(f"count_if({value} < 0 and not isnan({value}))").alias("__neg"),
        F.expr(f"count_if({value} <> 0 and not isnan({value}))").alias("__n"),
        F.count_if(~ok).alias("__odd"),
        F.percentile(F.log1p(F.greatest(finite(v), F.lit(0.0))), F.lit(0.99)).alias("__p99"),
    )
    top = F.when((F.col("__odd") > 0) | (F.col("__p99") <= 0), F.lit(1.0)).otherwise(F.col("__p99"))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(F.greatest(finite(v), F.lit(0.0))) / top))
    checked = F.when(F.col("__neg") * 2 > F.col("__n"), F.raise_error(F.lit("values look like decibels"))).otherwise(x)
    return df.join(stats, group).withColumn(out, checked).drop("__neg", "__n", "__odd", "__p99")


# --- time -----------------------------------------------------------------------------------------


def since_seeding(day: Column, seeding: Column) -> Column:
    return F.coalesce((day - seeding) / F.lit(365.0), F.lit(0.0))


def season_angle(day: Column) -> tuple[Column, Column]:
    """sin and cos of the day in the mean year; 0 where undated."""
    angle = F.lit(2.0) * F.pi() * F.pmod(day.cast("double"), F.lit(YEAR_DAYS)) / F.lit(YEAR_DAYS)
    return F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(0.0))


def ten_day_slot(day: Column, harvest_year: Column) -> Column:
    """0..71: days 1-10, 11-20 and 21 to the month's end from January of the year before harvest."""
    third = F.least(F.lit(2), F.expr("0") + F.floor((F.dayofmonth(day) - 1) / 10))
    return ((F.year(day) - harvest_year + 1) * 36 + (F.month(day) - 1) * 3 + third).cast("int")


def slot_bounds(spark, harvest_year: int) -> DataFrame:
    """(slot, first_day, last_day) of the 72 ten-day slots of a harvest year."""
    s = spark.range(72).select(F.col("id").cast("int").alias("slot"))
    month = F.make_date(F.lit(harvest_year - 1) + F.expr("slot div 36").cast("int"), F.expr("(slot % 36) div 3 + 1").cast("int"), F.lit(1))
    third = F.col("slot") % 3
    first = F.date_add(month, third * 10)
    return s.select("slot", first.alias("first_day"), F.when(third == 2, F.last_day(month)).otherwise(F.date_add(month, third * 10 + 9)).alias("last_day"))


def month_slot(day: Column, harvest_year: Column) -> Column:
    return ((F.year(day) - (harvest_year - 1)) * 12 + F.month(day) - 1).cast("int")


def months_between(df: DataFrame, start: str, end: str, out: str = "month") -> DataFrame:
    """A row for each month from that of `start` to that of `end`."""
    return df.withColumn(out, F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))))


def season_fraction(day: Column, seeding: Column, harvest: Column) -> Column:
    return F.when(harvest > seeding, (day - seeding) / (harvest - seeding))


#: Season windows as fractions of seeding to harvest.
EARLY, MID, LATE = (0.0, 0.3), (0.3, 0.8), (0.6, 1.0)


def in_window(fraction: Column, window: tuple[float, float]) -> Column:
    return fraction.between(*window)


def days_since_1970(units: Column, value: Column, calendar: Column) -> Column:
    """`value` counted by units like `days since 2016-01-01`; other units or calendars fail."""
    origin = F.to_date(F.regexp_extract(units, r"^days since (\d{4}-\d{2}-\d{2})", 1))
    known = calendar.isin("standard", "gregorian", "proleptic_gregorian") & units.rlike(r"^days since \d{4}-\d{2}-\d{2}")
    return F.when(known, value + F.datediff(origin, F.lit("1970-01-01").cast("date"))).otherwise(F.raise_error(F.concat(F.lit("unsupported time units "), units)).cast("int"))


#: Seeding and harvest month and day per crop group, and whether seeding falls in the year before.
FALLBACK_SEASONS = {
    "corn": ("05-01", "10-15", False), "soybean": ("05-15", "10-15", False), "winter_wheat": ("10-01", "07-01", True),
    "spring_wheat": ("04-25", "08-20", False), "canola": ("05-05", "08-25", False), "other_crop": ("04-01", "10-31", False),
}


def fallback_season(group: Column, year: Column) -> tuple[Column, Column]:
    """Seeding and harvest dates of a crop group where no calendar is known."""
    seeding = harvest = F.lit(None).cast("date")
    for name, (s, h, before) in FALLBACK_SEASONS.items():
        of = lambda md, y: F.make_date(y, F.lit(int(md[:2])), F.lit(int(md[3:])))
        seeding = F.when(group == name, of(s, year - 1 if before else year)).otherwise(seeding)
        harvest = F.when(group == name, of(h, year)).otherwise(harvest)
    return seeding, harvest


# --- terrain and soil -----------------------------------------------------------------------------


def aspect_parts(aspect: Column) -> tuple[Column, Column]:
    a = F.radians(finite(aspect))
    return F.sin(a), F.cos(a)


#: Azimuth that faces the pole, by country.
POLE_AZIMUTH = {"Argentina": 180.0, "Brazil": 180.0, "Uruguay": 180.0, "Germany": 0.0}


def lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def pole_facing(aspect: Column, country: Column, azimuths: dict[str, float] = POLE_AZIMUTH) -> Column:
    return F.cos(F.radians(finite(aspect) - lookup(country, azimuths)))


def depth_weighted(layers: list[Column], weights: tuple[float, ...] = (5.0, 10.0, 15.0)) -> Column:
    total = layers[0].cast("double") * weights[0]
    for c, w in zip(layers[1:], weights[1:]):
        total = total + c.cast("double") * w
    return total / F.lit(float(sum(weights)))


def fine_fraction(clay: Column, silt: Column, sand: Column) -> Column:
    return F.when(clay + silt + sand != 0, (clay + silt) / (clay + silt + sand))


# --- geography ------------------------------------------------------------------------------------


def unit_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def weather_cell(degrees: Column) -> Column:
    """The centre of the native 0.1 degree cell; halves go to the even tenth."""
    return F.bround(degrees * 10) / 10


def block_id(lat: Column, lon: Column, block_km: float) -> Column:
    dlat = F.lit(block_km / 111.0)
    dlon = F.lit(block_km) / (F.lit(111.0) * F.greatest(F.lit(0.1), F.cos(F.radians(lat))))
    return F.concat_ws(":", F.floor(lat / dlat).cast("string"), F.floor(lon / dlon).cast("string"))


def cell_centre(row: Column, col: Column, affine: Column) -> tuple[Column, Column]:
    """x and y of a cell's centre under (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    r, c, t = row + 0.5, col + 0.5, lambda k: F.get(affine, F.lit(k))
    return t(0) * c + t(1) * r + t(2), t(3) * c + t(4) * r + t(5)


def shifted_affine(affine: Column, row0: Column, col0: Column) -> Column:
    t = lambda k: F.get(affine, F.lit(k))
    return F.array(t(0), t(1), t(2) + t(0) * col0 + t(1) * row0, t(3), t(4), t(5) + t(3) * col0 + t(4) * row0)


def bounding_box(affine: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1); a rotated grid fails."""
    t = lambda k: F.get(affine, F.lit(k))
    x, y = (t(2), t(2) + t(0) * width), (t(5), t(5) + t(4) * height)
    box = F.struct(F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))
    return F.when((t(1) == 0) & (t(3) == 0), box).otherwise(F.from_json(F.raise_error(F.lit("rotated grid")).cast("string"), "x0 double, y0 double, x1 double, y1 double"))


# --- names and codes ------------------------------------------------------------------------------

SEASON_NAME = r"^([A-Za-z]+)_(DUP\d+)_(farm\d+)_(field\d+)_([a-z]+)_(\d{4})$"


def parse_season_name(name: Column) -> Column:
    """struct(country, provider, farm, field, crop, year); any other shape fails."""
    part = lambda k: F.regexp_extract(name, SEASON_NAME, k)
    country = F.when(name.rlike(SEASON_NAME), part(1)).otherwise(F.raise_error(F.concat(F.lit("unrecognised season name "), F.coalesce(name, F.lit("null")))))
    return F.struct(country.alias("country"), part(2).alias("provider"), part(3).alias("farm"), part(4).alias("field"), part(5).alias("crop"), part(6).try_cast("int").alias("year"))


def pair_code(country: Column, crop: Column, countries: dict[str, str], crops: dict[str, str]) -> Column:
    return F.concat_ws("-", lookup(country, countries), lookup(crop, crops))


def parse_pair(code: Column, countries: dict[str, str], crops: dict[str, str]) -> tuple[Column, Column]:
    parts = F.split(code, "-")
    back = lambda t: {v: k for k, v in t.items()}
    return lookup(F.get(parts, F.lit(0)), back(countries)), lookup(F.get(parts, F.lit(1)), back(crops))


#: Land cover codes of the crop groups, and the ranges of codes that are cropland at all.
GROUP_CODES = {"corn": (1,), "soybean": (5,), "winter_wheat": (24,), "spring_wheat": (22, 23), "canola": (31,)}
CROPLAND = ((1, 61), (66, 80), (200, 255))


def crop_group(code: Column) -> Column:
    """The group of a land cover code; other cropland is other_crop, the rest null."""
    crop = F.lit(False)
    for lo, hi in CROPLAND:
        crop = crop | code.between(lo, hi)
    out = F.when(crop, F.lit("other_crop"))
    for name, codes in GROUP_CODES.items():
        out = F.when(code.isin(*codes), F.lit(name)).otherwise(out)
    return out


#: The climate region of each state.
REGION_OF_STATE = {
    "WA": "northwest", "OR": "northwest", "ID": "northwest",
    "CA": "west", "NV": "west",
    "UT": "southwest", "CO": "southwest", "AZ": "southwest", "NM": "southwest",
    "MT": "northern_rockies_plains", "WY": "northern_rockies_plains", "ND": "northern_rockies_plains", "SD": "northern_rockies_plains", "NE": "northern_rockies_plains",
    "MN": "upper_midwest", "WI": "upper_midwest", "MI": "upper_midwest", "IA": "upper_midwest",
    "IL": "ohio_valley", "IN": "ohio_valley", "OH": "ohio_valley", "MO": "ohio_valley", "KY": "ohio_valley", "TN": "ohio_valley", "WV": "ohio_valley",
    "KS": "south", "OK": "south", "TX": "south", "AR": "south", "LA": "south", "MS": "south",
    "AL": "southeast", "GA": "southeast", "FL": "southeast", "SC": "southeast", "NC": "southeast", "VA": "southeast",
    "ME": "northeast", "NH": "northeast", "VT": "northeast", "MA": "northeast", "RI": "northeast", "CT": "northeast", "NY": "northeast", "NJ": "northeast", "PA": "northeast", "DE": "northeast", "MD": "northeast", "DC": "northeast",
}


def climate_region(state: Column) -> Column:
    return lookup(state, REGION_OF_STATE)


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def without_seed(run: Column) -> Column:
    return F.regexp_replace(run, r"[-_]s(eed)?\d+$", "")


# --- scaling --------------------------------------------------------------------------------------


def standardised(value: Column, mean: Column, std: Column, fill: float | None = None) -> Column:
    z = F.try_divide(finite(value) - mean, std)
    return z if fill is None else F.coalesce(z, F.lit(fill))


def min_max(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """(value - min) / (max - min) within the group; null in a constant group."""
    w = W.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)))


def count_exceeded(value: Column, breaks: Column, strict: bool = True) -> Column:
    """How many breaks the value exceeds (strict), or reaches."""
    return F.aggregate(breaks, F.lit(0), lambda n, b: n + ((value > b) if strict else (value >= b)).cast("int"))


def quantile_classes(df: DataFrame, value: str, by: list[str], quantiles: list[float], out: str, strict: bool = True) -> DataFrame:
    """Class of each value by the exact quantiles of its group: strict counts breaks exceeded, else zones are right-open."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, quantiles))).alias("__q")) if by else df.agg(F.percentile(value, F.array(*map(F.lit, quantiles))).alias("__q"))
    joined = df.join(q, by) if by else df.crossJoin(F.broadcast(q))  # one row
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), count_exceeded(F.col(value), F.col("__q"), strict))).drop("__q")


def display_stretch(df: DataFrame, value: str, by: list[str], out: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """0 to 255 between two percentiles of the group, clipped."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__q"))
    lo, hi = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    x = (F.col(value) - lo) / F.greatest(hi - lo, F.lit(1e-6))
    return df.join(q, by).withColumn(out, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255).cast("int")).drop("__q")


def weather_units(df: DataFrame, celsius: list[str], millimetres: list[str]) -> DataFrame:
    """Celsius to kelvin and millimetres to metres; days with any missing value are left out."""
    x = df.dropna(subset=[*celsius, *millimetres])
    return x.withColumns({**{c: F.col(c) + 273.15 for c in celsius}, **{c: F.col(c) / 1000.0 for c in millimetres}})


def standardised_by_registry(df: DataFrame, registry: dict[str, tuple[list[float], list[float]]], source: str, vector: str) -> DataFrame:
    """Array channels scaled by their source's registered means and deviations; unknown sources pass, a wrong channel count fails."""
    out = F.col(vector)
    for name, (mean, std) in registry.items():
        m, s = F.array(*map(F.lit, mean)), F.array(*[F.lit(x if x > 0 else 1.0) for x in std])
        z = F.transform(F.arrays_zip(F.col(vector).alias("v"), m.alias("m"), s.alias("s")), lambda x: (x["v"] - x["m"]) / x["s"])
        wrong = F.raise_error(F.lit(f"{name}: expected {len(mean)} channels")).cast("array<double>")
        out = F.when(F.col(source) == name, F.when(F.size(vector) == len(mean), z).otherwise(wrong)).otherwise(out)
    return df.withColumn(vector, out)


def packed_key(season: Column, row: Column, col: Column) -> Column:
    """One 64-bit key of a cell: season above bit 40, row above bit 20, column."""
    return F.shiftleft(season.cast("long"), 40).bitwiseOR(F.shiftleft(row.cast("long"), 20)).bitwiseOR(col.cast("long"))


def rgb_valid(bands: list[Column], day: Column, occupied: Column) -> Column:
    """All bands finite on a dated slot of an occupied position."""
    ok = day.isNotNull() & occupied
    for b in bands:
        ok = ok & finite(b).isNotNull()
    return F.coalesce(ok, F.lit(False))


def additive_hash(row: Column) -> Column:
    """An aggregate: a hash of rows (as text) in any order, from sums of the first four quarters of their SHA-256; nulls count as empty."""
    h = F.sha2(F.coalesce(row, F.lit("")).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(h, k, 8), 16, 10).cast("decimal(28,0)")).cast("string") for k in (1, 9, 17, 25)]
    return F.sha2(F.concat_ws(":", *parts).cast("binary"), 256)


def row_text(*columns: Column) -> Column:
    """Columns as one text that tells any two rows apart: each with its length before it, nulls by a mark."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.when(c.isNull(), F.lit("-;")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in text])


def additive_hash_sql(row: str) -> str:
    """The same as SQL, for oracles."""
    part = lambda k: f"CAST(sum(CAST('0x' || substr(sha256({row}), {k}, 8) AS BIGINT)) AS VARCHAR)"
    return f"sha256(concat_ws(':', {', '.join(part(k) for k in (1, 9, 17, 25))}))"


def text_key(c: Column) -> Column:
    """An integer below 2**28 from a text: the first digits of its SHA-256, which any engine with that hash can repeat."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 7), 16, 10).cast("long")


def text_key_sql(c: str) -> str:
    """The same as SQL, for oracles."""
    return f"CAST('0x' || substr(sha256({c}), 1, 7) AS BIGINT)"
