"""Quality and privacy gates.  A gate is a DataFrame of violations; ``enforce`` raises on any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MIN_MATCH_RATE, SUPPRESSION_THRESHOLD, WITHIN_TOLERANCE
from ..functions.numeric import total_skip_null, total_strict
from ..session import cut_lineage
from .assemble import POPULATION_PARTS
from .frames import explode_rows, extremes
from .quantiles import group_quantiles

EXEMPT_KEYS = ("stays_in_window", "suppression_threshold", "age_median")


class GateFailure(RuntimeError):
    """One or more gates found violations, or a required gate was skipped."""


def enforce(
    checks: Mapping[str, DataFrame | None],
    strict: bool = True,
    shown: int = 5,
    report: str | None = None,
) -> None:
    """Raise ``GateFailure`` naming the first violations of every failed gate.

    A gate given as ``None`` was skipped, which is a failure in strict mode. With ``report`` all violations
    of a failed gate are written as Parquet to a folder of the gate's name below that path.
    """
    failures = []
    for name, violations in checks.items():
        if violations is None:
            if strict:
                failures.append(f"{name}: check skipped")
            continue
        found = violations.limit(shown).collect()
        if found:
            failures.append(f"{name}: " + "; ".join(str(tuple(row)) for row in found))
            if report is not None:
                path = f"{report}/{name.replace(' ', '_')}"
                violations.write.parquet(path)
                failures[-1] += f"; all are in {path}"
    if failures:
        raise GateFailure("\n".join(failures))


# --- linkage ----------------------------------------------------------------

def check_match_rate(matches: DataFrame, floor: float = MIN_MATCH_RATE) -> DataFrame:
    """The unmatched rows, when the matched share of the listing is below ``floor``.

    The rate of an empty listing is zero, and one row says so.
    """
    rate = matches.agg(
        F.coalesce(F.try_divide(F.count("code"), F.count(F.lit(1))), F.lit(0.0)).alias("rate")
    ).scalar()
    unmatched = matches.filter(F.col("code").isNull() & (rate < floor)).select(
        F.lit("match_rate").alias("rule"), F.col("l_name").alias("key"),
        F.concat_ws(" ", F.lit("unmatched in"), "state").alias("detail"),
    )
    empty = matches.agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") == 0) & F.lit(floor > 0)).select(
        F.lit("match_rate").alias("rule"), F.lit(None).cast("string").alias("key"),
        F.lit("the listing is empty").alias("detail"),
    )
    return unmatched.unionByName(empty)


def check_collisions(matches: DataFrame) -> DataFrame:
    from .linkage import collisions

    return collisions(matches).select(
        F.lit("collision").alias("rule"), F.col("code").alias("key"),
        F.concat_ws(" by ", "l_name", "method").alias("detail"),
    )


# --- agreement with independent figures -------------------------------------

def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, NaN below three pairs or when a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    value = F.try_divide(F.covar_pop(x, y), spread)
    return F.when((F.count(x) >= 3) & (spread > 0), value).otherwise(F.lit(float("nan")))


def population_pairs(matches: DataFrame, listing: DataFrame, registry: DataFrame,
                     parts: Sequence[str] = POPULATION_PARTS, code: str = "code",
                     adp: str = "average_daily_population_last_year",
                     peak: str = "max_daily_population_last_year") -> DataFrame:
    """Matched pairs with both sides' population: ``code, l_id, ours, theirs, peak``.

    The listing total is strict: a row with any missing part gets none.
    """
    theirs = listing.select("l_id", total_strict(*[F.col(f"`{p}`") for p in parts]).alias("theirs"))
    ours = registry.select(
        F.col(code).alias("code"), F.col(adp).alias("ours"), F.col(peak).alias("peak")
    )
    matched = matches.filter(F.col("code").isNotNull()).select("l_id", "code")
    return matched.join(theirs, "l_id").join(ours, "code")


def positive_pairs(pairs: DataFrame, x: str = "ours", y: str = "theirs") -> DataFrame:
    return pairs.filter((F.col(x) > 0) & (F.col(y) > 0)).withColumn("ratio", F.col(y) / F.col(x))


def agreement(pairs: DataFrame, x: str = "ours", y: str = "theirs") -> DataFrame:
    """One row ``n, correlation, median_ratio`` over pairs with both sides above zero.

    The median is the upper one: the ratio at position ``n // 2`` in ascending order.
    """
    both = positive_pairs(pairs, x, y)
    middle = group_quantiles(both, [], ["ratio"], [0.5], method="upper").select("q_0").scalar()
    return both.agg(
        F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("correlation")
    ).select("n", "correlation", F.coalesce(middle, F.lit(float("nan"))).alias("median_ratio"))


def divergent_ratios(pairs: DataFrame, key: str = "code", k: int = 3) -> DataFrame:
    return extremes(positive_pairs(pairs), "ratio", [key], k)


def stay_pairs(pairs: DataFrame, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    usable = (F.col(ours) != 0) & (F.col(theirs) > 0)
    return pairs.filter(usable).withColumn("difference", F.col(theirs) - F.col(ours))


def within_share(pairs: DataFrame, tol: float = WITHIN_TOLERANCE, ours: str = "ours",
                 theirs: str = "theirs") -> DataFrame:
    """One row: pairs, correlation, and how many differ by at most ``tol`` of the larger side."""
    near = F.abs(F.col("difference")) <= tol * F.greatest(ours, theirs)
    counted = stay_pairs(pairs, ours, theirs).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col(ours), F.col(theirs)).alias("correlation"),
        F.count_if(near).alias("within"),
    )
    some = F.col("n") > 0
    return counted.select(
        "n", F.when(some, F.col("correlation")).alias("correlation"),
        F.when(some, F.col("within")).alias("within"),
        F.try_divide("within", "n").alias("within_share"),
    )


def difference_extremes(
    pairs: DataFrame, k: int = 3, ours: str = "ours", theirs: str = "theirs", tie: Sequence[str] = ("code",)
) -> DataFrame:
    """The k lowest and the k highest differences of the pairs that ``within_share`` counts."""
    return extremes(stay_pairs(pairs, ours, theirs), "difference", tie, k)


def stale_rows(pairs: DataFrame) -> DataFrame:
    """Pairs whose listing total exceeds the highest value the registry ever saw, worst first."""
    over = (F.col("theirs") > 0) & (F.col("peak") > 0) & (F.col("theirs") > F.col("peak"))
    stale = pairs.filter(over).withColumn("ratio", F.col("theirs") / F.col("peak"))
    return stale.orderBy(F.col("ratio").desc(), F.col("code").desc())


# --- profiles and records ---------------------------------------------------

def _violation(rule: str, key: Column | str, detail: Column) -> list[Column]:
    key = F.col(key) if isinstance(key, str) else key
    return [F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.alias("detail")]


def _small(n: Column, threshold: int) -> Column:
    return (n > 0) & (n < threshold)


def check_profiles(
    stats: DataFrame, cells: DataFrame, key: str = "code", threshold: int = SUPPRESSION_THRESHOLD,
    counts: Sequence[str] = (
        "age_known", "n_completed", "n_set", "n_posted", "unique_people", "people_with_recorded_set",
    ),
    medians: Mapping[str, str] | None = None,
) -> DataFrame:
    """Visible counts below the threshold, negative medians, medians without a publishable sample.

    ``medians`` maps a median column to the count it rests on.  ``stays_in_window`` is exempt.
    """
    medians = {"median_set": "n_set", "median_posted": "n_posted"} if medians is None else medians
    bad_cells = cells.filter(_small(F.col("n.n"), threshold)).select(
        *_violation("small_cell", key, F.concat_ws(".", "dim", "value"))
    )
    problems = [
        F.when(_small(F.col(c)["n"], threshold), F.struct(F.lit("small_cell"), F.lit(c)))
        for c in counts
    ]
    for median, count in medians.items():
        n = F.col(count)["n"]
        problems.append(F.when(F.col(median) < 0, F.struct(F.lit("negative_median"), F.lit(median))))
        problems.append(
            F.when(
                F.col(median).isNotNull() & F.coalesce(n < threshold, F.lit(True)),
                F.struct(F.lit("median_without_sample"), F.lit(median)),
            )
        )
    bad_stats = explode_rows(stats, [key], F.array(*problems), "p").select(
        F.col("p.col1").alias("rule"), F.col(key).cast("string").alias("key"), F.col("p.col2").alias("detail")
    )
    return bad_cells.unionByName(bad_stats)


def check_build(placed: DataFrame, unplaced: DataFrame, registry: DataFrame) -> DataFrame:
    """Assembled records against the registry they were built from.

    Nothing lost or doubled, coordinates present and on the globe, no uncited operator
    company, and every approximate point explained.
    """
    every = placed.select("code").unionByName(unplaced.select("code"))
    size = registry.agg(F.count(F.lit(1)).alias("n")).scalar()
    lost = every.agg(F.count(F.lit(1)).alias("shipped")).filter(F.col("shipped") != size).select(
        *_violation("count_mismatch", F.lit(None), F.concat_ws(" of ", F.col("shipped").cast("string"), size.cast("string")))
    )
    doubled = every.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *_violation("duplicate_code", "code", F.col("n").cast("string"))
    )
    p = F.col("properties")
    lat, lon = F.col("latitude"), F.col("longitude")
    no_point = lat.isNull() | lon.isNull()
    rules = {
        "null_geometry": no_point,
        "impossible_coordinates": ~(lat.between(-90, 90) & lon.between(-180, 180)),
        "uncited_company": p["operator"]["company"].isNotNull(),
        "unexplained_point": (p["approx"] == 1) & (F.coalesce(p["location_note"], F.lit("")) == ""),
    }
    hits = F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()])
    broken = explode_rows(placed, ["code"], hits, "rule").select(
        "rule", F.col("code").cast("string").alias("key"), F.lit(None).cast("string").alias("detail")
    )
    return lost.unionByName(doubled).unionByName(broken)


def shipped_leaves(lines: DataFrame) -> DataFrame:
    """Every demographics leaf of shipped feature lines: ``code, threshold, path, leaf``.

    Reads the JSON text itself, at any depth, without assuming what it should hold: levels are
    opened until no value is an object any more.
    """
    records = lines.select(
        F.get_json_object("value", "$.properties.code").alias("code"),
        F.get_json_object("value", "$.properties.demographics").alias("text"),
    ).filter(F.col("text").isNotNull())
    threshold = F.coalesce(
        F.get_json_object("text", "$.suppression_threshold").try_cast("int"), F.lit(SUPPRESSION_THRESHOLD)
    )
    leaves = _text_leaves(records, threshold)
    return leaves.select(
        "code", "threshold", "keys", F.concat_ws(".", "code", "keys").alias("path"), "leaf"
    )


def check_suppression(lines: DataFrame) -> DataFrame:
    """Integer leaves of shipped demographics in (0, threshold), with their path."""
    leaves = shipped_leaves(lines)
    exempt = F.arrays_overlap("keys", F.array(*[F.lit(k) for k in EXEMPT_KEYS]))
    number = F.when(F.col("leaf").rlike(r"^-?\d+$"), F.col("leaf").try_cast("bigint"))
    return leaves.filter(~exempt & (number > 0) & (number < F.col("threshold"))).select(
        F.lit("small_cell").alias("rule"), F.col("path").alias("key"), F.col("leaf").alias("detail")
    )


def check_shipped_suppression(spark: SparkSession, path: str) -> DataFrame:
    """``check_suppression`` on a release as it lies on disk."""
    return check_suppression(spark.read.text(path + "/features"))


def records_checked(lines: DataFrame) -> DataFrame:
    demographics = F.get_json_object("value", "$.properties.demographics")
    return lines.agg(F.count(demographics).alias("facilities_checked"))


def _text_leaves(records: DataFrame, threshold: Column) -> DataFrame:
    """``code, threshold, keys, leaf`` of records ``code, text``, the text a JSON object of any depth."""
    as_map = "map<string,string>"
    closed = records.select(
        "code", threshold.alias("threshold"), F.array().cast("array<string>").alias("keys"), F.col("text").alias("leaf")
    )
    leaves = None
    while True:
        opened = closed.select(
            "code", "threshold", "keys", F.explode(F.from_json("leaf", as_map)).alias("key", "leaf")
        ).select("code", "threshold", F.array_append("keys", F.col("key")).alias("keys"), "leaf")
        is_object = F.coalesce(F.ltrim("leaf").startswith("{"), F.lit(False))
        flat = opened.filter(~is_object)
        leaves = flat if leaves is None else leaves.unionByName(flat)
        closed = cut_lineage(opened.filter(is_object))
        if closed.isEmpty():
            return leaves


def check_shipped_profiles(lines: DataFrame, profiles: DataFrame, registry: DataFrame, code: str = "code") -> DataFrame:
    """Shipped demographics against the profiles they came from: presence of every entity that has one, and
    every value at any depth, by path. Profiles of entities that the registry lacks are not shipped.
    """
    shipped = lines.select(
        F.get_json_object("value", "$.properties.code").alias("code"),
        F.get_json_object("value", "$.properties.demographics").alias("text"),
    ).filter(F.col("text").isNotNull())
    source = profiles.join(registry.select(code), code, "left_semi").select(
        F.col(code).cast("string").alias("code"), F.to_json("demographics", {"ignoreNullFields": "false"}).alias("text")
    )

    def flat(df: DataFrame, side: str) -> DataFrame:
        leaves = _text_leaves(df, F.lit(0)).select("code", F.concat_ws(".", "keys").alias("path"), F.struct("leaf").alias(side))
        return leaves.unionByName(df.select("code", F.lit("").alias("path"), F.struct(F.lit("").alias("leaf")).alias(side)))

    both = flat(shipped, "shipped").join(flat(source, "expected"), ["code", "path"], "full_outer")
    ours, theirs = F.col("shipped.leaf"), F.col("expected.leaf")
    missing = F.col("shipped").isNull() | F.col("expected").isNull()
    rule = F.when(missing, "fidelity.profile_presence").otherwise("fidelity.profile_value")
    broken = missing | ~ours.eqNullSafe(theirs)
    return both.filter(broken).select(
        rule.alias("rule"), F.col("code").alias("key"), F.concat_ws(" ", "path", F.concat_ws(" <> ", ours, theirs)).alias("detail")
    )


def shipped_records(lines: DataFrame) -> DataFrame:
    """What ``check_build`` reads, taken from shipped feature lines: ``code, latitude, longitude, properties``."""
    schema = (
        "geometry struct<coordinates: array<double>>, properties struct<code: string, "
        "operator: struct<company: string>, approx: int, location_note: string>"
    )
    parsed = lines.select(F.from_json("value", schema).alias("f"))
    at = F.col("f.geometry.coordinates")
    return parsed.select(
        "f.properties.code", F.get(at, 1).alias("latitude"), F.get(at, 0).alias("longitude"), "f.properties"
    )


FIDELITY_FIELDS = {
    "ice_fy_adp_male_criminal": "Male Crim",
    "ice_fy_adp_male_noncriminal": "Male Non-Crim",
    "ice_fy_adp_female_criminal": "Female Crim",
    "ice_fy_adp_female_noncriminal": "Female Non-Crim",
    "ice_fy_adp_mandatory": "Mandatory",
}


def check_fidelity(shipped: DataFrame, expected: DataFrame, fields: Sequence[str],
                   key: str = "code") -> DataFrame:
    """Shipped figures that differ from their source, null-safely; rows only on one side too."""
    left = shipped.select(key, F.struct(*fields).alias("shipped"))
    right = expected.select(key, F.struct(*fields).alias("expected"))
    both = left.join(right, key, "full_outer")
    present = F.col("shipped").isNotNull() & F.col("expected").isNotNull()
    problems = [F.when(~present, F.struct(F.lit("presence"), F.lit(None).cast("string")))]
    for f in fields:
        ours, source = F.col("shipped")[f], F.col("expected")[f]
        problems.append(
            F.when(
                present & ~ours.eqNullSafe(source),
                F.struct(F.lit(f), F.concat_ws(" <> ", ours.cast("string"), source.cast("string"))),
            )
        )
    return explode_rows(both, [key], F.array(*problems), "p").select(
        F.concat(F.lit("fidelity."), F.col("p.col1")).alias("rule"),
        F.col(key).cast("string").alias("key"), F.col("p.col2").alias("detail"),
    )


def expected_population(attached: DataFrame, code: str = "code") -> DataFrame:
    """The population figures a record must ship, taken from the sources again."""
    listed = F.col("attributes")
    parts = [listed.getField(p).cast("double") for p in POPULATION_PARTS]
    return attached.select(
        F.col(code).alias("code"),
        F.col("average_daily_population_last_year").cast("double").alias("ddp_avg_daily_trailing_year"),
        F.col("max_daily_population_last_year").cast("double").alias("ddp_max_daily_trailing_year"),
        total_skip_null(*parts).alias("ice_fy_adp_total"),
        *[listed.getField(c).cast("double").alias(f) for f, c in FIDELITY_FIELDS.items()],
    )


def shipped_population(lines: DataFrame) -> DataFrame:
    """The population figures of shipped feature lines."""
    names = ["ddp_avg_daily_trailing_year", "ddp_max_daily_trailing_year", "ice_fy_adp_total", *FIDELITY_FIELDS]
    schema = "properties struct<code: string, population: struct<{}>>".format(
        ", ".join(f"{n}: double" for n in names)
    )
    parsed = lines.select(F.from_json("value", schema).alias("f"))
    return parsed.select("f.properties.code", "f.properties.population.*")
