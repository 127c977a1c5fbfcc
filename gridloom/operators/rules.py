"""Rules: gates, library and annotation checks, completeness, composite index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EARLY, LATE, MID, guarded_ratio, in_window, season_fraction
from ..util import spread

#: Crops of rain-fed summers, highest temperature without stress by crop, organic soil limit, least relief.
RAINFED_SUMMER = ("corn", "soybean")
NON_STRESS_TMAX = {"corn": 35.0, "soybean": 35.0, "wheat": 32.0, "rapeseed": 30.0}
ORGANIC_SOC, LEAST_RELIEF = 120.0, 1.0


def gates(crop: Column, tmax: Column, rain_rank: Column, relief: Column, soc: Column) -> dict[str, Column]:
    """Gate columns; an unknown input closes its gate, and the one that weather of this grain can't resolve never opens."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in NON_STRESS_TMAX.items() for x in kv]), crop)
    no = lambda c: F.coalesce(c, F.lit(False))
    return {"rainfed_crop": no(crop.isin(*RAINFED_SUMMER)), "no_heat_stress": no(tmax <= limit), "dry_half": no(rain_rank < 0.5), "has_relief": no(relief >= LEAST_RELIEF), "thermal_pattern": F.lit(False), "mineral_soil": no(soc < ORGANIC_SOC)}


def season_indices(obs: DataFrame, by: list[str], day: Column, seeding: Column, harvest: Column, nir: Column, red: Column, edge: tuple[Column, Column], swir: Column) -> DataFrame:
    """Per unit: NDVI rise (season maximum - early minimum), mid-season NDRE and NDMI means, late mean over maximum (if above 0.1)."""
    f = season_fraction(day, seeding, harvest)
    x = obs.withColumns({"__f": f, "__v": guarded_ratio(nir, red), "__e": guarded_ratio(*edge), "__m": guarded_ratio(nir, swir)})
    at = lambda c, w: F.when(in_window(F.col("__f"), w), F.col(c))
    g = x.groupBy(*by).agg(F.max(at("__v", (0.0, 1.0))).alias("__top"), F.min(at("__v", EARLY)).alias("__low"), F.avg(at("__v", LATE)).alias("__late"), F.avg(at("__e", MID)).alias("ndre_mid"), F.avg(at("__m", MID)).alias("ndmi_mid"))
    return g.select(*by, (F.col("__top") - F.col("__low")).alias("ndvi_rise"), "ndre_mid", F.when(F.col("__top") > 0.1, F.col("__late") / F.col("__top")).alias("persist_ratio"), "ndmi_mid")


def peak(obs: DataFrame, by: list[str], value: Column) -> DataFrame:
    return obs.groupBy(*by).agg(F.max(value).alias("peak"))


def raw_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, missing, p5, p50, p95) of a wide table, in one pass."""
    q = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    one = df.agg(*[x for c in columns for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__n"), F.percentile(c, q).alias(f"{c}__q"))])
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}__n").alias("missing"), *[F.get(f"{c}__q", F.lit(i)).alias(p) for i, p in enumerate(("p5", "p50", "p95"))]) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def evidence(obs: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Count, mean, least and largest value per unit and channel, in long form."""
    long = obs.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels])).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "channel").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def library_errors(concepts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, error): repeated ids, channels of two owners, rules within a family or to unknown ends, presence out of [0, 1], no approval."""
    twice = concepts.select("id").unionByName(rules.select("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("error"))
    owners = concepts.select("id", F.explode("channels").alias("c"))
    shared = owners.join(owners.groupBy("c").agg(F.count_distinct("id").alias("k")).filter("k > 1"), "c").select("id", F.concat(F.lit("shared channel "), "c").alias("error"))
    family = concepts.select("id", "family")
    ends = rules.join(family.select(F.col("id").alias("concept_a"), F.col("family").alias("fa")), "concept_a", "left").join(family.select(F.col("id").alias("concept_b"), F.col("family").alias("fb")), "concept_b", "left")
    unknown = ends.filter("fa is null or fb is null").select("id", F.lit("unknown concept").alias("error"))
    same = ends.filter("fa = fb").select("id", F.lit("concepts of one family").alias("error"))
    presence = rules.filter("minimum_presence is null or minimum_presence not between 0 and 1").select("id", F.lit("presence out of range").alias("error"))
    approval = concepts.select("id", "review").unionByName(rules.select("id", "review")).filter("coalesce(review, '') <> 'approved'").select("id", F.lit("not approved").alias("error"))
    out = twice
    for e in (shared, unknown, same, presence, approval):
        out = out.unionByName(e)
    return out.distinct()


def response_errors(responses: DataFrame, wanted: DataFrame, allowed: DataFrame) -> DataFrame:
    """(sample, error) of annotation responses (sample, items array<struct<id, score, cites array<string>>>).

    Each response must have exactly the wanted ids once, scores in [0, 1] or null for unknown, and cite allowed evidence only; one without
    items has every error. `wanted` and `allowed` are tables of ids.
    """
    items = responses.select("sample", F.posexplode_outer("items").alias("__i", "x")).select("sample", "__i", "x.*")
    want = wanted.select("id").distinct()
    known = items.filter("__i is not null").join(want.withColumn("__w", F.lit(True)), "id", "left")
    g = known.groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("__w"), F.col("id"))).alias("w"), F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("off"))
    cited = items.select("sample", F.explode("cites").alias("cite"))
    odd = cited.filter("cite is null").select("sample").unionByName(cited.join(allowed.select(F.col("id").alias("cite")).distinct(), "cite", "left_anti").select("sample")).distinct().withColumn("odd", F.lit(True))
    x = responses.select("sample", F.col("items").isNull().alias("none")).join(g, "sample", "left").join(odd, "sample", "left").crossJoin(want.agg(F.count("*").alias("m")))  # one row
    none = F.col("none")
    bad = {"wrong ids": none | (F.coalesce("n", F.lit(0)) != F.col("m")) | (F.coalesce("w", F.lit(0)) != F.col("m")), "score out of range": none | (F.coalesce("off", F.lit(0)) > 0), "citation not allowed": none | F.col("odd").isNotNull()}
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()]), lambda e: e.isNotNull())
    return x.select("sample", F.explode(errors).alias("error"))


STATUSES = ("estimated", "unknown", "not_observable")


def annotation_errors(annotations: DataFrame, definitions: DataFrame, channels: list[str], vision: bool = False) -> DataFrame:
    """(sample, id, error) of annotations (sample, kind, id, status, score, confidence, cites array<string>, reason) against the library's
    definitions (kind, id, channels array<string>, family); kinds are concepts and rules.

    A sample has each definition once and nothing else. An estimate has score and confidence in [0, 1] and cites evidence; other statuses have neither number, as
    unknown is not a negative. Evidence is the dates, channels of the concept (of a rule: any of `channels`) and, with vision, the image for rules and
    optical concepts; a concept's estimate needs more than dates. Every record has a reason. Errors of a whole sample have a null id.
    """
    d = definitions.select("kind", "id", F.col("channels").alias("__own"), "family", F.lit(True).alias("__known"))
    annotations = spread(annotations, "sample", parts=6)  # all groups below are within a sample, so they need no further shuffle; a task holds several at once
    a = annotations.join(F.broadcast(d), ["kind", "id"], "left")  # a library's definitions
    names = F.array(*map(F.lit, channels)).cast("array<string>")
    sensors = F.transform(F.when(F.col("kind") == "concepts", F.col("__own")).otherwise(names), lambda c: F.concat(F.lit("channels."), c))
    image = F.when(F.lit(vision) & ((F.col("kind") == "rules") | (F.col("family") == "optical")), F.array(F.lit("image"))).otherwise(F.array().cast("array<string>"))
    beyond = F.concat(F.coalesce(sensors, F.array().cast("array<string>")), image)
    estimated = F.col("status") == "estimated"
    inside = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    cites = F.coalesce("cites", F.array().cast("array<string>"))
    bad = {
        "unknown id": F.col("__known").isNull(),
        "invalid status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "invalid score": estimated & ~(inside("score") & inside("confidence")),
        "unknown is not a negative": ~estimated & (F.col("score").isNotNull() | F.col("confidence").isNotNull()),
        "unsupported citation": F.col("cites").isNull() | F.exists(cites, lambda c: c.isNull()) | (F.size(F.array_except(cites, F.concat(beyond, F.array(F.lit("dates"))))) > 0),
        "estimate without evidence": estimated & (F.size(cites) == 0),
        "no sensor evidence": estimated & (F.col("kind") == "concepts") & (F.size(cites) > 0) & (F.size(F.array_intersect(cites, beyond)) == 0),
        "no reason": F.coalesce(F.trim("reason") == "", F.lit(True)),
    }
    own = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad.items()]), lambda e: e.isNotNull())
    twice = annotations.groupBy("sample", "kind", "id").agg(F.count("*").alias("n")).filter("n > 1").select("sample", "id", F.lit("repeated id").alias("error"))
    had = F.when(F.col("__known"), F.struct("kind", "id"))
    lacking = a.groupBy("sample").agg(F.count_distinct(had).alias("n")).crossJoin(d.agg(F.count_distinct("kind", "id").alias("m"))).filter(F.col("n") < F.col("m"))  # one row
    missing = lacking.select("sample", F.lit(None).cast("string").alias("id"), F.lit("missing ids").alias("error"))
    # the three parts name different errors
    return a.select("sample", "id", F.explode(own).alias("error")).distinct().unionByName(twice.distinct()).unionByName(missing)


def acceptance_errors(annotations: DataFrame, prepared: DataFrame, audited: DataFrame, profile: str) -> DataFrame:
    """(sample, error): not prepared, another profile, stale hash, not audited, repeated, or not a training sample."""
    p = prepared.select("sample", F.col("hash").alias("__h"), F.col("partition").alias("__p"))
    a = annotations.join(p, "sample", "left").join(audited.select("sample", F.lit(True).alias("__a")).distinct(), "sample", "left").join(annotations.groupBy("sample").agg(F.count("*").alias("__n")), "sample")
    bad = {"not prepared": F.col("__h").isNull(), "other profile": F.col("profile") != profile, "stale": F.col("hash") != F.col("__h"), "not audited": F.col("__a").isNull(), "repeated": F.col("__n") > 1, "not a training sample": F.col("__p") != "train"}
    errors = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad.items()]), lambda e: e.isNotNull())
    return a.select("sample", F.explode(errors).alias("error")).distinct()


def complete_only(results: DataFrame, expected: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Results of the experiments that have at least the expected number of units."""
    have = results.groupBy(*by).agg(F.count_distinct(unit).alias("__have"))
    ok = have.join(expected, by).filter(F.col("__have") >= F.col("expected")).select(*by)
    return results.join(ok, by, "left_semi")


def health(units: DataFrame, criteria: dict[str, Column], medians: list[str], support: str, least: int = 10) -> DataFrame:
    """One row: how many units meet each criterion, and medians over the units with enough support."""
    big = F.col(support) >= least
    return units.agg(F.count("*").alias("units"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in criteria.items()], *[F.median(F.when(big, F.col(m))).alias(f"median_{m}") for m in medians])


def status_rollup(jobs: DataFrame, done: DataFrame, failed: DataFrame, skipped: DataFrame, key: str, by: str) -> DataFrame:
    """By job: runs done, failed, skipped and pending; done counts over failed, failed over skipped."""
    x = jobs
    for name, t in (("d", done), ("f", failed), ("s", skipped)):
        x = x.join(t.select(key, F.lit(True).alias(f"__{name}")).distinct(), key, "left")
    state = F.when(F.col("__d"), "done").when(F.col("__f"), "failed").when(F.col("__s"), "skipped").otherwise("pending")
    return x.groupBy(by).agg(*[F.count_if(state == s).alias(s) for s in ("done", "failed", "skipped", "pending")])


def supported(df: DataFrame, by: list[str], value: str, least: int) -> DataFrame:
    """Rows of the groups in which at least `least` values are known."""
    ok = df.groupBy(*by).agg(F.count(value).alias("__n")).filter(F.col("__n") >= least).select(*[F.col(b).alias(f"__{b}") for b in by])
    same = None
    for b in by:
        one = F.col(b).eqNullSafe(F.col(f"__{b}"))
        same = one if same is None else same & one
    return df.join(ok, same, "left_semi")
