"""Sources and sinks: strict schemas, dictionaries, text and page tables, manifests, guarded publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTY_SCHEMA = "FIPS string, State string, County string"
YIELD_SCHEMA = "year int, state_ansi string, county_ansi string, state_name string, county_name string, production double, yield double"
WEATHER_SCHEMA = "fips string, grid int, year int, month int, day int, kind string, tavg double, tmax double, tmin double, prec double, rh double, wind double, radiation double, vpd double"


def read_counties(spark: SparkSession, path: str, states: dict[str, str]) -> DataFrame:
    """County list with state codes; FIPS stays text, padded to five digits."""
    from ..functions.scalars import lookup

    c = spark.read.csv(path, header=True, schema=COUNTY_SCHEMA)
    return c.select(F.lpad("FIPS", 5, "0").alias("FIPS"), "State", "County", lookup(F.col("State"), states).alias("state_code"))


def county_manifest(counties: DataFrame, wanted: list[str] | None, year: str, root: str, past: int = 5) -> DataFrame:
    """Nested paths of a county sample: months 4 to 9 of the year, all months of the past years, quarterly imagery."""
    c = counties if wanted is None else counties.filter(F.col("FIPS").isin(wanted))
    path = lambda y, m: F.concat(F.lit(f"{root}/weather/"), y.cast("string"), F.lit("/"), F.col("FIPS"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit(".csv"))
    y = F.col(year)
    short = F.transform(F.sequence(F.lit(4), F.lit(9)), lambda m: path(y, m))
    long = F.transform(F.sequence(F.lit(past), F.lit(1), F.lit(-1)), lambda k: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: path(y - k, m)))
    imagery = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: F.concat(F.lit(f"{root}/imagery/"), y.cast("string"), F.lit("/"), F.col("FIPS"), F.lit("-q"), q.cast("string"), F.lit(".h5")))
    return c.select("FIPS", y.alias("year"), F.struct(F.struct(short.alias("short_term"), long.alias("long_term")).alias("weather"), imagery.alias("imagery")).alias("data"))


def county_yields(table: DataFrame, state: str, county: str) -> DataFrame:
    """Yields of one county with padded codes and log yield."""
    t = table.withColumns({"state_ansi": F.lpad("state_ansi", 2, "0"), "county_ansi": F.lpad("county_ansi", 3, "0")})
    return t.filter((F.col("state_ansi") == state) & (F.col("county_ansi") == county)).select("year", "state_ansi", "county_ansi", "production", "yield", F.log("yield").alias("log_yield"))


def trimmed(df: DataFrame) -> DataFrame:
    """Blanks around column names removed."""
    return df.toDF(*[c.strip() for c in df.columns])


def daily_series(df: DataFrame, group: list[str], day: str, values: list[str], last_day: int = 28) -> DataFrame:
    """Days 1 to `last_day` of each group as one ordered array of structs (a month of days at most)."""
    return df.filter(F.col(day).between(1, last_day)).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(day, *values))).alias("series"))


def strict_columns(df: DataFrame, wanted: list[str], full: bool = False) -> DataFrame:
    """Columns by exact name, in order; repeated, missing or, with `full`, extra names fail."""
    have = df.columns
    twice = sorted({c for c in have if have.count(c) > 1})
    gone = [c for c in wanted if c not in have]
    extra = [c for c in have if c not in wanted] if full else []
    if twice or gone or extra:
        raise ValueError(f"columns: repeated {twice}, missing {gone}, extra {extra}")
    return df.select(*[f"`{c}`" for c in wanted])


def decoded(df: DataFrame, dictionary: DataFrame, column: str, name: str, by: list[str] = ()) -> DataFrame:
    """The column's codes replaced by a dictionary (var, code, value); an unknown code fails when it is read. Code 0 is valid."""
    d = dictionary.filter(F.col("var") == name).select(*[F.col(b).alias(f"__{b}") for b in by], F.col("code").alias("__code"), F.col("value").alias("__value"), F.lit(True).alias("__known"))
    x = df.join(d, [F.col(column) == F.col("__code"), *[F.col(b) == F.col(f"__{b}") for b in by]], "left").drop(*[f"__{b}" for b in by])
    bad = F.raise_error(F.concat(F.lit(f"unknown {name} code "), F.col(column).cast("string"))).cast("string")
    return x.withColumn(column, F.when(F.col("__known") | F.col(column).isNull(), F.col("__value")).otherwise(bad)).drop("__code", "__value", "__known")


def unknown_members(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct values of the column that the known table doesn't have."""
    return df.select(F.col(column).alias("member")).distinct().join(known.select(F.col(key).alias("member")), "member", "left_anti")


def season_table(rows: DataFrame, season: str = "season_id", target: str = "target", constant: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """One row a season: size, grid extent, target mean and deviation, distinct dates; a column that should be constant but isn't fails."""
    same = [F.when(F.count_distinct(c) <= 1, F.min(c)).otherwise(F.raise_error(F.lit(f"{c} differs within a season"))).alias(c) for c in constant]
    return rows.groupBy(season).agg(F.count("*").alias("n_rows"), F.min("grid_row").alias("row0"), F.max("grid_row").alias("row1"), F.min("grid_col").alias("col0"), F.max("grid_col").alias("col1"), F.avg(target).alias("target_mean"), F.stddev_pop(target).alias("target_std"), *same, *[F.size(F.collect_set(c)).alias(f"{c}_values") for c in dates])


#: Stores whose byte ranges a task can read itself; files of others are read whole, which Spark does up to 2 GB.
RANGED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def file_ends(paths: DataFrame, ends: int) -> DataFrame:
    """(path, length, digest, bytes_read): the hash of the first and last `ends` bytes of each file, read as two ranges in a task.

    `paths` are (path, length); a file that is gone or shorter than its length fails.
    """

    def run(batches):
        import hashlib
        import re

        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            out = []
            for path, length in zip(pdf["path"], pdf["length"]):
                uri = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", path))
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    parts = [f.read_at(min(ends, length), 0), f.read_at(min(ends, length), max(0, length - ends))]
                if any(len(p) != min(ends, length) for p in parts):
                    raise OSError(f"{path} is shorter than {length} bytes")
                out.append((path, int(length), hashlib.sha256(b"".join(parts)).hexdigest(), sum(map(len, parts))))
            yield pd.DataFrame(out, columns=["path", "length", "digest", "bytes_read"])

    return paths.mapInPandas(run, "path string, length long, digest string, bytes_read long")


def fingerprints(spark: SparkSession, path: str, ends: int = 1 << 16) -> DataFrame:
    """(path, length, digest) of files that aren't empty: size with the hash of head and tail. Only these bytes are read, whatever the size, where the store serves ranges."""
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", "length")  # a listing: contents that no column asks for aren't read
    scheme = F.regexp_extract("path", r"^([a-z0-9]+):", 1)
    other = listed.filter(~scheme.isin(*RANGED)).isEmpty()
    ranged = file_ends(listed.filter(scheme.isin(*RANGED)), ends).drop("bytes_read")
    if other:
        return ranged
    tail = F.expr(f"substring(content, greatest(1, length(content) - {ends} + 1), {ends})")
    whole = files.filter(~scheme.isin(*RANGED)).select("path", "length", F.sha2(F.concat(F.expr(f"substring(content, 1, {ends})"), tail), 256).alias("digest"))
    return ranged.unionByName(whole)


def changed(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Paths whose size or hash differs from the record, or that only one side has."""
    r = recorded.select("path", F.col("length").alias("__l"), F.col("digest").alias("__d"))
    x = now.join(r, "path", "full_outer")
    return x.filter(~(F.col("length").eqNullSafe(F.col("__l")) & F.col("digest").eqNullSafe(F.col("__d")))).select("path")


def check_snapshot(actual: DataFrame, expected: DataFrame, key: str, facts: list[str]) -> None:
    """Fails with every mismatch of the expectations table, not only the first."""
    e = expected.select(key, *[F.col(c).alias(f"__{c}") for c in facts])
    x = e.join(actual, key, "left")
    wrong = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.concat(F.col(key).cast("string"), F.lit(f": {c} "), F.coalesce(F.col(c).cast("string"), F.lit("missing")), F.lit(", expected "), F.col(f"__{c}").cast("string"))) for c in facts]), lambda m: m.isNotNull())
    bad = [m for r in x.select(wrong.alias("m")).filter(F.size("m") > 0).orderBy("m").collect() for m in r.m]  # a row an expectation
    if bad:
        raise ValueError("; ".join(bad))


def with_run_parts(df: DataFrame, pattern: str, names: list[str], path: Column | None = None) -> DataFrame:
    """Columns from the parts of each row's file path."""
    p = F.input_file_name() if path is None else path
    return df.withColumns({n: F.regexp_extract(p, pattern, i + 1) for i, n in enumerate(names)})


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name over the union of the columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


NUMBER = r"^-?\d+(\.\d+)?$"


def mean_std_runs(values: Column) -> Column:
    """array<struct<mean, std>> from glued cells like 0.84±0.071.13±0.22.

    All deviations but the last have two decimals, or one where two would leave no number for the next mean.
    """
    chunks = F.split(F.replace(values, F.lit(" "), F.lit("")), "±")
    inner = F.slice(chunks, 2, F.greatest(F.size(chunks) - 2, F.lit(0)))
    rest = r"-?\d+(?:\.\d+)?$"
    std = lambda c: F.when(c.rlike(r"^\d+\.\d{2}" + rest), F.regexp_extract(c, r"^(\d+\.\d{2})", 1)).when(c.rlike(r"^\d+\.\d" + rest), F.regexp_extract(c, r"^(\d+\.\d)", 1)).otherwise(F.raise_error(F.concat(F.lit("cannot split "), c)).cast("string"))
    stds = F.concat(F.transform(inner, std), F.array(F.element_at(chunks, -1)))
    means = F.concat(F.array(F.element_at(chunks, 1)), F.transform(inner, lambda c: F.substring(c, F.length(std(c)) + 1, F.length(c))))
    return F.zip_with(means, stds, lambda m, s: F.struct(m.cast("double").alias("mean"), s.cast("double").alias("std")))


def benchmark_rows(lines: DataFrame, headings: dict[str, Column], row: Column, models: str, pairs: list[str], order: str = "line_no", text: str = "line", by: list[str] = ()) -> DataFrame:
    """Rows of a text table: headings carried forward over the lines, model rows split into pairs of (r2, rmse).

    `headings` gives each heading column its value on its own lines and null elsewhere; `row` is the cell text of a model row
    and null elsewhere; `models` is a pattern whose first group is the model's name.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = lines.withColumns({k: F.last(c, ignorenulls=True).over(w) for k, c in headings.items()}).withColumns({"__cells": row, "model": F.regexp_extract(text, models, 1)}).filter("__cells is not null")
    cells = mean_std_runs(F.col("__cells"))
    checked = F.when(F.size(cells) == 2 * len(pairs), cells).otherwise(F.raise_error(F.concat(F.lit("wrong number of cells in "), F.col("__cells"))).cast("array<struct<mean:double,std:double>>"))
    x = x.withColumn("__c", checked).select("*", F.posexplode(F.array(*map(F.lit, pairs))).alias("__i", "pair"))
    r2, rmse = F.get("__c", F.col("__i") * 2), F.get("__c", F.col("__i") * 2 + 1)
    return x.select(*by, *headings, "model", "pair", r2["mean"].alias("r2_mean"), r2["std"].alias("r2_std"), rmse["mean"].alias("rmse_mean"), rmse["std"].alias("rmse_std"))


def html_rows(pages: DataFrame, key: str, html: str, row_tag: str = "tr", cell_tag: str = "t[dh]") -> DataFrame:
    """(key, row, cells): the tagged rows of pages with their cells' plain text."""
    plain = lambda c: F.trim(F.replace(F.replace(F.replace(F.replace(F.regexp_replace(c, r"<[^>]+>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(rf"(?s)<{row_tag}(?:\s[^>]*)?>(.*?)</{row_tag}>"), F.lit(1))).alias("row", "__r"))
    cells = F.transform(F.regexp_extract_all("__r", F.lit(rf"(?s)<{cell_tag}(?:\s[^>]*)?>(.*?)</{cell_tag}>"), F.lit(1)), plain)
    return rows.select(key, "row", cells.alias("cells"))


def numeric_rows(rows: DataFrame, n: int) -> DataFrame:
    """Rows with exactly n numeric cells: the texts and the numbers."""
    num = F.filter("cells", lambda c: c.rlike(NUMBER))
    return rows.filter(F.size(num) == n).select(*[c for c in rows.columns if c != "cells"], F.filter("cells", lambda c: ~c.rlike(NUMBER)).alias("texts"), F.transform(num, lambda c: c.cast("double")).alias("numbers"))


def publish(df: DataFrame, path: str, checks: list[tuple[str, Column]] = ()) -> None:
    """Write to a staging folder, read it back, verify, then rename; an existing target is refused and never touched."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, staging = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staging"))
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(target):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(f"{path}.staging")
    back = spark.read.schema(df.schema).parquet(f"{path}.staging")
    facts = back.agg(F.count("*").alias("__rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks]).first()
    bad = {n: facts[n] for n, _ in checks if facts[n]}
    if bad:
        fs.delete(staging, True)
        raise ValueError(f"not published, rows that break a check: {bad}")
    if not fs.rename(staging, target):
        raise OSError(f"could not rename to {path}")


def pending(items: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Items that the ledger doesn't record as done."""
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def availability(listing: DataFrame, key: str, layer: str, path: str, layers: list[str]) -> DataFrame:
    """A row a sample: the path of each layer, whether it is there, and how many are."""
    p = listing.groupBy(key).pivot(layer, layers).agg(F.min(path))
    flags = {f"has_{x}": F.col(x).isNotNull() for x in layers}
    return p.withColumns(flags).withColumn("available", reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in flags]))


def report(df: DataFrame, rows: list[str], column: str, values: list[str], value: str, digits: int = 2) -> DataFrame:
    """Report shape: a column per value, formatted, with the mean over them."""
    p = df.groupBy(*rows).pivot(column, values).agg(F.avg(value))
    known = F.filter(F.array(*[F.col(f"`{v}`") for v in values]), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return p.select(*rows, *[F.format_number(F.col(f"`{v}`"), digits).alias(v) for v in values], F.format_number(mean, digits).alias("mean"))


def with_interval(point: Column, low: Column, high: Column, digits: int = 3) -> Column:
    """`point [low, high]`, starred where the interval leaves out 0."""
    f = f"%.{digits}f"
    return F.concat(F.format_string(f"{f} [{f}, {f}]", point, low, high), F.when((low > 0) | (high < 0), "*").otherwise(""))


def best_flag(df: DataFrame, by: list[str], value: str, lowest: bool = False) -> DataFrame:
    w = W.partitionBy(*by)
    return df.withColumn("is_best", F.col(value) == (F.min(value) if lowest else F.max(value)).over(w))


def content_hash(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free content hash per group: row hashes are summed, so a group is never collected."""
    from ..functions.scalars import additive_hash, row_text

    return df.groupBy(*by).agg(F.count("*").alias("rows"), additive_hash(row_text(*[F.col(c) for c in columns])).alias("hash"))


def parsed_json(df: DataFrame, column: str, schema: str | T.StructType, out: str = "parsed") -> DataFrame:
    return df.withColumn(out, F.from_json(column, schema))


def read_weather(spark: SparkSession, paths: list[str], schema: str, wanted: list[str]) -> DataFrame:
    """Daily weather CSV files of seasons; columns that some lack become null."""
    parts = [trimmed(spark.read.csv(p, header=True)) for p in paths]
    x = union_all(parts)
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    return x.select(*[(F.col(c).try_cast(kinds[c]) if c in x.columns else F.lit(None).cast(kinds[c])).alias(c) for c in wanted])


def read_tiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tile metadata, a JSON object a line, with the season's id."""
    t = spark.read.schema(schema).json(path)
    return t.withColumn("season_id", F.concat_ws("_", "country", "field"))


def tiles_for(tiles: DataFrame, assigned: DataFrame, partition: str, crops: list[str] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Tiles of a partition's seasons, of some crops only, without excluded seasons."""
    x = tiles.join(assigned.filter(F.col("partition") == partition).select("season_id"), "season_id", "left_semi")
    if crops is not None:
        x = x.filter(F.col("crop").isin(crops))
    return x if excluded is None else x.join(excluded.select("season_id"), "season_id", "left_anti")
