"""The given tables seen as registry, listing, stays, gazetteer and releases.

Everything here is derived by Spark from whole tables; nothing is made up on the driver and
no rows are left out, so the work of every catalogue query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import trailing_window
from ..session import by_shuffle, pin_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stays: order lines as events -------------------------------------------

def stays(spark: SparkSession, sf_dir: str, key: str = "l_suppkey", windowed: bool = True) -> DataFrame:
    """Order lines with their order: entity, person, times, dimensions and nullable amounts.

    The window is taken before the join so that its bound reaches the lineitem scan.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", key, "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount"
    )
    if windowed:
        lines = trailing_window(lines, "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col(key).alias("code"),
        F.col("o_custkey").alias("person"),
        F.col("o_orderdate").alias("book_in"),
        F.col("l_shipdate").alias("book_out"),
        (F.lit(1930) + F.pmod("o_custkey", F.lit(75))).cast("int").alias("birth_year"),
        F.col("l_returnflag").alias("gender"),
        F.col("l_linestatus").alias("criminality"),
        F.col("o_orderpriority").alias("release_reason"),
        F.col("o_orderstatus").alias("classification"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("amount_set"),
        F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).alias("amount_posted"),
    )


# --- registry and listing: parts --------------------------------------------

def _suffix(*steps: tuple[str, int]) -> Column:
    """`` W<key div a> K<key div b>``: tokens shared by a fixed number of parts each."""
    words = [F.concat(F.lit(f" {w}"), F.floor(F.col("p_partkey") / d).cast("string")) for w, d in steps]
    return F.concat(*words)


def _part_words() -> Column:
    """Words after the part name: a token that 4 % of all names hold, and nine more in one name of forty."""
    key = F.col("p_partkey")
    hub = F.when(F.pmod(key, F.lit(25)) == 7, F.lit(" hub")).otherwise("")
    group = F.floor(key / 400).cast("string")
    more = F.concat(*[F.concat(F.lit(f" U{i}x"), group) for i in range(1, 10)])
    return F.concat(hub, F.when(F.pmod(key, F.lit(40)) == 11, more).otherwise(""))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a registry entity: brand is the block, size the secondary key."""
    name = F.concat("p_name", _part_words(), _suffix(("W", 40), ("K", 9)), F.lit(" ctr"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"),
        name.alias("name"),
        F.col("p_brand").alias("state"),
        F.col("p_size").cast("string").alias("zip"),
        F.col("p_partkey").alias("r_order"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part again as a keyless listing row, its name and place edited in eight ways."""
    way = F.pmod("p_partkey", F.lit(8))
    w, wk = _suffix(("W", 40)), _suffix(("W", 40), ("K", 9))
    key, more = F.col("p_partkey").cast("string"), _part_words()
    name = (
        F.when(way == 0, F.concat("p_name", more, wk, F.lit(" Center")))
        .when(way == 2, F.concat(F.lit("The"), wk, F.lit(" center")))
        .when(way == 3, F.concat(F.col("p_name"), F.lit("s"), more, wk, F.lit(" ctr")))
        .when(way == 4, F.concat(F.lit("alias "), key))
        .when(way == 5, F.concat(F.lit("unknown place "), key))
        .when(way == 6, F.concat("p_name", more, w, F.lit(" ctr")))
        .otherwise(F.concat("p_name", more, wk, F.lit(" ctr")))
    )
    same_zip = way.isin(0, 6, 7)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_id"),
        name.alias("name"),
        F.when(way == 7, "Nowhere").otherwise(F.col("p_brand")).alias("state"),
        F.when(same_zip, F.col("p_size")).otherwise(F.col("p_size") + 1000).cast("string").alias("zip"),
    )


def key_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A human decision for every ``alias`` row of the listing; half of them claim a taken code."""
    aliased = table(spark, sf_dir, "part").withColumn("way", F.pmod("p_partkey", F.lit(8)))
    key = F.col("p_partkey").cast("string")
    taken = F.pmod("p_partkey", F.lit(16)) == 4
    chosen = F.when(taken, F.col("p_partkey") - 4).otherwise(F.col("p_partkey"))
    return aliased.select(
        F.when(F.col("way") == 4, F.concat(F.lit("ALIAS "), key)).alias("name_key"),
        F.upper("p_brand").alias("state"),
        F.concat(F.lit("P"), chosen.cast("string")).alias("code"),
    ).filter(F.col("name_key").isNotNull())


# --- gazetteer: parts as places ---------------------------------------------

def _latitude(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(160)) - F.lit(80) + F.lit(0.5)


def _longitude(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(340)) - F.lit(170) + F.lit(0.25)


def _place_word() -> Column:
    return F.concat("p_name", _suffix(("w", 8)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a gazetteer line, named in six census styles."""
    way, word = F.pmod("p_partkey", F.lit(6)), _place_word()
    name = (
        F.when(way == 0, F.concat(word, F.lit(" city")))
        .when(way == 1, F.concat(F.lit("Town of "), word, F.lit(" City village")))
        .when(way == 2, F.concat(word, F.lit("-Davidson metropolitan government (balance)")))
        .when(way == 3, F.concat(word, F.lit(" city and borough")))
        .when(way == 4, F.concat(word, F.lit(" City")))
        .otherwise(F.concat(word, F.lit(" CDP")))
    )
    return table(spark, sf_dir, "part").select(
        F.upper("p_brand").alias("state"),
        name.alias("name"),
        F.col("p_retailprice").alias("area"),
        _latitude("p_partkey").alias("latitude"),
        _longitude("p_partkey").alias("longitude"),
        F.col("p_partkey").alias("row_id"),
    )


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types per brand as counties; later parts overwrite earlier ones."""
    return table(spark, sf_dir, "part").select(
        F.upper("p_brand").alias("state"),
        F.concat("p_type", F.lit(" County")).alias("name"),
        _latitude("p_partkey").alias("latitude"),
        _longitude("p_partkey").alias("longitude"),
        F.col("p_partkey").alias("row_id"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an entity whose name may hold a place; four in five lack a coordinate."""
    way, word = F.pmod("p_partkey", F.lit(6)), _place_word()
    key = F.col("p_partkey").cast("string")
    name = (
        F.when(way == 0, F.concat(F.lit("ERO "), word, F.lit(" Hold Room")))
        .when(way == 1, F.concat(F.lit("Hold Room ("), word, F.lit(" "), "p_brand", F.lit(")")))
        .when(way == 2, F.concat("p_type", F.lit(" County Jail")))
        .when(way == 3, F.concat(F.lit("no such place "), key))
        .when(way == 4, F.concat(F.lit("south/"), word, F.lit(" Office")))
        .otherwise(F.concat(word, F.lit(" Annex")))
    )
    has_point = F.pmod("p_partkey", F.lit(5)) == 0
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        name.alias("name"),
        F.when(way == 5, "XX").otherwise(F.col("p_brand")).alias("state"),
        F.when(has_point, _latitude("p_partkey")).alias("latitude"),
        F.when(has_point, _longitude("p_partkey")).alias("longitude"),
    )


def location_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-placed points for a share of the entities that no gazetteer knows."""
    rows = entities(spark, sf_dir).filter(F.col("name").startswith("no such place "))
    placed = F.struct(
        F.lit(10.5).alias("latitude"), F.lit(20.25).alias("longitude"),
        F.lit("manual_county_seat").alias("precision"), F.lit("Somewhere").alias("matched_to"),
        F.lit("Hand-placed: by rule").alias("source"),
    )
    decided = F.pmod("p_partkey", F.lit(4)) == 1
    return rows.select(
        F.upper("name").alias("name_key"), F.upper("state").alias("state"),
        F.when(decided, placed).alias("located"),
    ).filter(F.col("located").isNotNull())


# --- releases: customers before and after a date ----------------------------

def release_at(spark: SparkSession, sf_dir: str, later: bool, cut: str = "1998-01-01") -> DataFrame:
    """Customers by their orders before the cut, or from the cut on.

    Customers with fewer than three orders have no published figure.
    """
    day = F.col("o_orderdate")
    bound = F.lit(cut).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").filter(day >= bound if later else day < bound)
    per = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("o_orderpriority").alias("contract_type"),
        F.max("o_orderstatus").alias("last_rating"),
    )
    customers = table(spark, sf_dir, "customer")
    return per.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("code"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("city"),
        F.col("c_mktsegment").alias("state"),
        F.when(F.col("n") >= 3, F.col("n") * F.lit(12.0)).alias("adp"),
        "contract_type",
        F.lit(None).cast("string").alias("company"),
        "last_rating",
        F.lit(None).cast("string").alias("last_end_date"),
    )


# --- figures per part: two independent totals -------------------------------

def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: line count times 25 (ours), peak, and quantity by flag with gaps (theirs)."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_discount")

    def part(flag: str) -> Column:
        return F.sum(F.when((F.col("l_returnflag") == flag) & (F.col("l_discount") > 0.03), F.col("l_quantity")))

    return lines.groupBy("l_partkey").agg(
        (F.count(F.lit(1)) * F.lit(25.0)).alias("ours"),
        (F.max("l_quantity") * F.lit(8.0)).alias("peak"),
        part("A").alias("part_a"), part("N").alias("part_n"), part("R").alias("part_r"),
        F.max(F.when(F.col("l_discount") > 0.03, F.col("l_quantity"))).alias("level_a"),
    ).withColumnRenamed("l_partkey", "code")


def full_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their own population figures, in the columns of the published registry."""
    own = population(spark, sf_dir).select(
        F.col("code").alias("p_partkey"),
        F.col("ours").alias("average_daily_population_last_year"),
        F.col("peak").alias("max_daily_population_last_year"),
    )
    rows = entities(spark, sf_dir).join(by_shuffle(own), "p_partkey", "left")
    return rows.withColumnRenamed("p_partkey", "code")


def full_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with its attributes, in the columns of the published sheet."""
    rating = F.element_at(F.array(F.lit("Pass"), F.lit("Fail"), F.lit("Superior")),
                          (F.pmod("code", F.lit(3)) + 1).cast("int"))
    return population(spark, sf_dir).select(
        F.col("code").alias("l_id"),
        F.col("part_a").alias("Male Crim"), F.col("part_n").alias("Male Non-Crim"),
        F.col("part_r").alias("Female Crim"), F.lit(None).cast("double").alias("Female Non-Crim"),
        F.col("level_a").alias("Mandatory"), F.col("level_a").alias("Level A"),
        rating.alias("Last Final Rating"),
    )


def key_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four listing rows matched to their part, the rest left open."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_id"),
        F.when(F.pmod("p_partkey", F.lit(4)) != 3, F.col("p_partkey")).alias("code"),
    )


# --- campaigns: documents ---------------------------------------------------

def _at_least_six(key):
    """Leading zeros for a short key; a longer key stays whole."""
    return F.when(F.length(key) < 6, F.lpad(key, 6, "0")).otherwise(key)


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a campaign row: a page gives the address, the whole text is the summary.

    ``short_summary`` is the first sentence of the text.
    """
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    key = F.col("doc_id").cast("string")
    way = F.pmod("doc_id", F.lit(9))
    https = F.concat(F.lit("https://fund.example/cases/"), key)
    statuses = F.array(*[F.lit(s) for s in ("accepting", "funded", "bond_posted", "accepting", "closed")])
    categories = F.array(*[F.lit(c) for c in ("immigration_only", "not_reported", "other", "conviction_reported")])
    return docs.join(pages, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("BF-"), _at_least_six(F.when(way == 8, F.lit("7")).otherwise(key))).alias("case_id"),
        F.when(way > 2, F.col("lang")).otherwise("").alias("region"),
        F.when(way == 1, F.concat(F.col("n_chars").cast("string"), F.lit(".5")))
        .otherwise(F.col("n_chars").cast("string")).alias("bond_amount"),
        F.pmod("n_chars", F.lit(997)).cast("string").alias("amount_raised"),
        F.element_at(categories, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("booking_category"),
        F.concat(F.lit("2026-07-"), F.lpad((F.pmod("doc_id", F.lit(33)) + 1).cast("string"), 2, "0")).alias("verified_on"),
        F.concat(F.lit("2026-08-"), F.lpad((F.pmod("doc_id", F.lit(28)) + 1).cast("string"), 2, "0")).alias("verification_expires_on"),
        F.col("text").alias("public_summary"),
        F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0).alias("short_summary"),
        F.coalesce("url", https).alias("contribution_url"),
        F.when(way == 5, "").otherwise(F.col("source")).alias("contribution_recipient"),
        F.when(way == 6, F.concat(F.lit("https://user@fund.example/"), key)).otherwise(https).alias("terms_url"),
        F.element_at(statuses, (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("status"),
        F.when(way == 4, "false").otherwise("true").alias("consent_confirmed"),
    )


# --- usage events -----------------------------------------------------------

def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp and an engagement time in milliseconds."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.round(F.col("value") * 100, 0).cast("bigint").alias("engagement_ms"),
    )


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first event was not an error gave consent."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(F.struct("ts", "event_id", "event_type")).alias("first")
    )
    return first.filter("first.event_type <> 'error'").select("user_id")
