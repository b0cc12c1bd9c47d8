"""Record linkage: a staged, conservative cascade from a keyless listing to a registry.

How the stages stay linear in the data
--------------------------------------
Registry names with equal token sets are one class with a count and one of their codes, and
listing names are looked up once per distinct set of tokens that the registry knows at all.
The zip stage reads the first answer, whether one candidate alone shares a token, from counts
per token. For the other one, the largest overlap and how many candidates reach it, the
*rarest* token of a set is looked up first in an inverted index over the classes, which gives
an overlap ``k`` that is reached; a candidate with ``k`` or more must hold one of the
``size - k + 1`` rarest tokens, so only those are looked up then, and the overlap of every
class found is counted exactly. Containment looks up the rarest token only and verifies the
rest. There is one plan for names of any length.

Only the fuzzy stage has to compare names one by one. It runs on the distinct names no
earlier stage decided, against the distinct registry names sharing a distinctive token; a pair
is produced at one token only. Letter counts bound the similarity of a pair from above: pairs
of a name are scored best bound first, and those whose bound is below the best score so far
are skipped. In both similarities the rarest token of a name gives a score that is reached;
other pairs are joined only where letter counts, compared as bits in the join, leave room for
as much, and only at as many tokens as that room can lose. Posting lists longer than
``POSTING_CHUNK`` are cut into chunks in all stages, so that a hot token spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FUZZY_THRESHOLD, GENERIC_TOKEN_MAX_DF
from ..functions.text import distinct_tokens, normalize_tokens, zip5
from ..session import broadcast_if_few, by_shuffle, cut_lineage, spread
from .frames import explode_rows

POSTING_CHUNK = 5_000
#: About how many names of a longer posting list are tried for a first score; it only sets a bound.
FIRST_TRIES = 200
ANY_TOKEN = "*"
ZIP_CLASS = ["state", "zip5", "tokens"]
#: Characters counted apart for the similarity bound; all others count together.
LETTERS = " ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


# --- tokens -----------------------------------------------------------------

def token_frequency(df: DataFrame, name: str) -> DataFrame:
    """``(token, df, share)``: in how many names a token occurs, out of all names."""
    tokens = df.select(distinct_tokens(name).alias("tokens"))
    total = tokens.select(F.count(F.lit(1)).alias("n")).scalar()
    per_token = explode_rows(tokens, [], F.col("tokens"), "token").groupBy("token")
    return per_token.agg(F.count(F.lit(1)).alias("df")).select(
        "token", "df", (F.col("df") / total).alias("share")
    )


def generic_tokens(df: DataFrame, name: str, max_df: float = GENERIC_TOKEN_MAX_DF) -> DataFrame:
    """Tokens in more than ``max_df`` of all names: too common to identify anything.

    Their number is bounded by (tokens per name) / ``max_df`` whatever the table size.
    """
    return token_frequency(df, name).filter(F.col("share") > max_df)


def _generic_array(df: DataFrame, name: str, max_df: float) -> Column:
    """The bounded set of generic tokens as one scalar array."""
    return generic_tokens(df, name, max_df).agg(F.collect_list("token").alias("tokens")).scalar()


# --- prepared inputs --------------------------------------------------------

def _with_tokens(df: DataFrame, name: str, zip_code: str, generic: Column) -> DataFrame:
    words = df.withColumn("_words", normalize_tokens(name))
    distinctive = F.array_except("_words", generic)
    return words.withColumns(
        {
            "norm": F.array_join("_words", " "),
            "tokens": F.sort_array(distinctive),
            "zip5": zip5(zip_code),
        }
    ).drop("_words")


def prepare(
    listing: DataFrame,
    registry: DataFrame,
    max_df: float = GENERIC_TOKEN_MAX_DF,
    listing_columns: Sequence[str] = ("l_id", "name", "state", "zip"),
    registry_columns: Sequence[str] = ("code", "name", "state", "zip", "r_order"),
    keep: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Both sides in the form the stages work on.

    Listing: ``l_id, l_name, name_key, state, zip5, norm, tokens``; registry: ``code,
    r_order, state, zip5, norm, tokens``.  ``tokens`` are the distinctive ones, sorted.
    ``r_order`` is the registry's row order, which decides between equal candidates.

    Both sides feed several indexes, so by default they are checkpointed, not computed again.
    """
    l_id, l_name, l_state, l_zip = listing_columns
    r_code, r_name, r_state, r_zip, r_order = registry_columns
    generic = _generic_array(registry, r_name, max_df)
    left = spread(listing, l_id).select(
        F.col(l_id).alias("l_id"),
        F.col(l_name).alias("l_name"),
        F.upper(F.trim(l_name)).alias("name_key"),
        F.upper(F.trim(l_state)).alias("state"),
        F.col(l_zip).alias("_zip"),
    )
    right = spread(registry, r_code).select(
        F.col(r_code).alias("code"),
        F.col(r_order).alias("r_order"),
        F.col(r_name).alias("r_name"),
        F.upper(r_state).alias("state"),
        F.col(r_zip).alias("_zip"),
    )
    left = _with_tokens(left, "l_name", "_zip", generic).drop("_zip")
    right = _with_tokens(right, "r_name", "_zip", generic).drop("_zip", "r_name")
    return (cut_lineage(left), cut_lineage(right)) if keep else (left, right)


# --- index ------------------------------------------------------------------

def _token_index(registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., token) -> n, lowest and highest code`` over the registry."""
    return explode_rows(registry, [*keys, "code"], F.col("tokens"), "token").groupBy(*keys, "token").agg(
        F.count(F.lit(1)).alias("n"), F.min("code").alias("low"), F.max("code").alias("high")
    )


def _known_tokens(classes: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``classes`` (keys..., tokens) with ``known``: (n, token, low, high) of the tokens in the index,
    the rarest first. Classes without such a token are left out."""
    index = _token_index(registry, keys)
    each = explode_rows(classes, [*keys, "tokens"], F.col("tokens"), "token")
    entry = F.struct("n", "token", "low", "high")
    return each.join(by_shuffle(index), [*keys, "token"]).groupBy(*keys, "tokens").agg(
        F.sort_array(F.collect_list(entry)).alias("known")
    )


def _long_lists(postings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys...) -> chunks`` of the posting lists that are longer than one chunk."""
    sizes = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    chunks = sizes.filter(F.col("n") > POSTING_CHUNK).select(
        *keys, F.ceil(F.col("n") / POSTING_CHUNK).cast("int").alias("chunks")
    )
    return broadcast_if_few(cut_lineage(chunks))


def _cut(postings: DataFrame, long_lists: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Every posting in one ``chunk`` of its list."""
    chunk = F.pmod(F.xxhash64(by), F.coalesce("chunks", F.lit(1))).cast("int")
    return postings.join(long_lists, list(keys), "left").withColumn("chunk", chunk).drop("chunks")


def _spread(probes: DataFrame, long_lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every probe once for each ``chunk`` of the list it asks for."""
    each = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    return probes.join(long_lists, list(keys), "left").withColumn("chunk", each).drop("chunks")


class _Postings:
    """Inverted index over the classes of equal token sets: (keys..., token) -> class, n, first code."""

    def __init__(self, registry: DataFrame, keys: Sequence[str]) -> None:
        self.keys = [*keys, "token"]
        classes = registry.filter(F.size("tokens") > 0).groupBy(*keys, F.col("tokens").alias("r_tokens")).agg(
            F.count(F.lit(1)).alias("names"), F.min("code").alias("first_code")
        )
        self.rows = classes.withColumn("token", F.explode("r_tokens"))
        self.long_lists = _long_lists(self.rows, self.keys)

    def holding(self, probes: DataFrame) -> DataFrame:
        """``probes`` (keys..., token, ...) with every class that holds their token."""
        cut = _cut(self.rows, self.long_lists, self.keys, "r_tokens")
        return _spread(probes, self.long_lists, self.keys).join(by_shuffle(cut), [*self.keys, "chunk"])


# --- stages -----------------------------------------------------------------

def link_override(listing: DataFrame, overrides: DataFrame) -> DataFrame:
    """Stage 1, a human decision on ``(name_key, state)``; the code is taken as given."""
    chosen = overrides.select("name_key", "state", "code")
    return listing.join(by_shuffle(chosen), ["name_key", "state"]).select(
        "l_id", "code", F.lit("override").alias("method"), _no_score()
    )


def _best_overlaps(sets: DataFrame, postings: _Postings) -> DataFrame:
    """``sets`` (keys..., known_tokens, the rarest first) with ``top``: the largest number of tokens that a
    registry name shares with the set, how many names share so many, and the lowest code of them."""
    columns = sets.columns
    width = F.size(F.array_intersect("known_tokens", "r_tokens"))

    def hits(probes: DataFrame) -> DataFrame:
        return postings.holding(probes).withColumn("width", width)

    rarest = hits(sets.withColumn("token", F.element_at("known_tokens", 1)))
    reached = rarest.groupBy(*columns).agg(F.max("width").alias("reached"))
    prefix = F.slice("known_tokens", F.lit(1), F.size("known_tokens") - F.col("reached") + 1)
    found = hits(reached.withColumn("token", F.explode(prefix)).drop("reached")).filter(
        F.element_at(F.array_intersect("known_tokens", "r_tokens"), 1) == F.col("token")
    )
    per_width = found.groupBy(*columns, "width").agg(
        F.sum("names").alias("n"), F.min("first_code").alias("code")
    )
    return per_width.groupBy(*columns).agg(F.max(F.struct("width", "n", "code")).alias("top"))


def _known_at_zip(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """``ZIP_CLASS, known, only``: the tokens of a listing class that registry names at its zip hold, and
    whether one name alone holds all of them."""
    classes = listing.filter(F.col("zip5").isNotNull()).select(*ZIP_CLASS).distinct()
    known = _known_tokens(classes, registry.filter(F.col("zip5").isNotNull()), ["state", "zip5"])
    return known.withColumn("only", F.array_min("known.low") == F.array_max("known.high"))


def _evidence_by_class(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Zip evidence once per distinct (state, zip, tokens) of the listing, copies share it."""
    keys = ["state", "zip5"]
    known = cut_lineage(_known_at_zip(listing, registry).withColumn("known_tokens", F.col("known.token")))
    # One candidate alone, or one token, which is shared with as many names as hold it.
    settled = F.col("only") | (F.size("known") == 1)
    plain = known.filter(settled).select(*ZIP_CLASS, "only", F.struct(
        F.size("known").alias("width"), F.when(F.col("only"), F.lit(1)).otherwise(F.col("known")[0]["n"]).alias("n"),
        F.array_min("known.low").alias("code"),
    ).alias("top"))
    open_ = known.filter(~settled)
    postings = _Postings(registry.filter(F.col("zip5").isNotNull()), keys)
    tops = _best_overlaps(open_.select(*keys, "known_tokens").distinct(), postings)
    several = open_.join(by_shuffle(tops), [*keys, "known_tokens"]).select(*ZIP_CLASS, "only", "top")
    return plain.unionByName(several).select(
        *ZIP_CLASS, "only", F.col("top.code").alias("top_code"), F.col("top.n").alias("top_n"),
        F.col("top.width").alias("top_width"),
    )


def zip_evidence(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """What shared zip plus shared distinctive tokens say about each listing row.

    ``(l_id, tokens, only, top_code, top_n, top_width)``: ``only`` is whether exactly one
    candidate shares a token at the zip; ``top_n`` candidates share ``top_width`` tokens, the
    largest number.
    """
    found = listing.select("l_id", *ZIP_CLASS).join(by_shuffle(_evidence_by_class(listing, registry)), ZIP_CLASS)
    return found.select("l_id", "tokens", "only", "top_code", "top_n", "top_width")


def _token_share() -> Column:
    return F.bround(F.col("top_width") / F.greatest(F.size("tokens"), F.lit(1)), 3)


def _no_score() -> Column:
    return F.lit(None).cast("double").alias("score")


def link_key_token(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Stage 2, exactly one candidate at the zip shares a distinctive token."""
    alone = _known_at_zip(listing, registry).filter("only").select(
        *ZIP_CLASS, F.array_min("known.low").alias("code")
    )
    return listing.join(by_shuffle(alone), ZIP_CLASS).select(
        "l_id", "code", F.lit("zip+token").alias("method"), _no_score()
    )


def link_strict_winner(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Stage 3, several candidates at the zip and one shares strictly more tokens than the rest."""
    several = zip_evidence(listing, registry).filter("not only and top_n = 1")
    return several.select(
        "l_id",
        F.col("top_code").alias("code"),
        F.lit("zip+token:multi").alias("method"),
        _token_share().alias("score"),
    )


def _exact_index(registry: DataFrame) -> DataFrame:
    first = F.min(F.struct("r_order", "code"))
    return registry.groupBy("state", "norm").agg(first.alias("_first")).select(
        "state", "norm", F.col("_first.code").alias("exact_code")
    )


def link_exact(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Stage 4, equal normal name in the state; the first in registry order wins."""
    return listing.join(by_shuffle(_exact_index(registry)), ["state", "norm"]).select(
        "l_id", F.col("exact_code").alias("code"), F.lit("exact-name").alias("method"), _no_score()
    )


def _containment_by_class(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """``(state, tokens, contain_code)`` where one candidate alone holds all the tokens."""
    classes = listing.filter(F.size("tokens") > 0).select("state", "tokens").distinct()
    known = cut_lineage(
        _known_tokens(classes, registry, ["state"]).filter(F.size("known") == F.size("tokens"))
    )
    rarest = F.col("known")[0]
    single = known.filter(F.size("known") == 1).select(
        "state", "tokens", rarest["n"].alias("n"), rarest["low"].alias("contain_code")
    )
    probes = known.filter(F.size("known") > 1).select("state", "tokens", rarest["token"].alias("token"))
    several = (
        _Postings(registry, ["state"]).holding(probes)
        .filter(F.size(F.array_except("tokens", "r_tokens")) == 0)
        .groupBy("state", "tokens").agg(F.sum("names").alias("n"), F.min("first_code").alias("contain_code"))
    )
    return single.unionByName(several).filter("n = 1").drop("n")


def link_containment(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Stage 5, all distinctive tokens occur in one candidate of the state and in no other."""
    found = listing.join(by_shuffle(_containment_by_class(listing, registry)), ["state", "tokens"])
    return found.select(
        "l_id",
        F.col("contain_code").alias("code"),
        F.lit("distinctive-token").alias("method"),
        F.lit(1.0).alias("score"),
    )


def _ratio_udf():
    """The similarity as a pandas UDF.

    The function is nested so that it travels to the workers by value: they need pandas and
    the standard library, not this package.
    """

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        matcher, scores, current = SequenceMatcher(None), [], None
        for a, b in zip(left, right):
            if b != current:
                matcher.set_seq2(b)
                current = b
            matcher.set_seq1(a)
            scores.append(matcher.ratio())
        return pd.Series(scores, dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType())


def difflib_ratio(left: Column | str, right: Column | str) -> Column:
    """Ratcliff-Obershelp similarity, first argument first: the measure is not symmetric."""
    return _ratio_udf()(left, right)


def levenshtein_ratio(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    return F.coalesce(F.try_divide(longest - F.levenshtein(left, right), longest), F.lit(1.0))


SIMILARITY = {
    "difflib": difflib_ratio,
    "levenshtein": levenshtein_ratio,
}


def letter_counts(name: Column) -> Column:
    """How often each of ``LETTERS`` occurs, and how many other characters there are."""
    counts = [F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))) for c in LETTERS]
    rest = F.length(F.translate(name, LETTERS, ""))
    return F.array(*counts, rest).cast("array<smallint>")


def ratio_bound(left: Column, right: Column) -> Column:
    """The Ratcliff-Obershelp similarity that two names could reach at most, from their letter counts.

    Matched blocks never use a character more often than both names hold it. Characters that are
    counted together only raise the bound. Numerator and divisor are those of the similarity, so
    the bound is never below it, not even by rounding.
    """
    total = lambda counts: F.aggregate(counts, F.lit(0), lambda n, c: n + c)
    shared = total(F.zip_with(left, right, lambda a, b: F.least(a, b).cast("int")))
    length = total(left) + total(right)
    return F.when(length == 0, F.lit(1.0)).otherwise((F.lit(2.0) * shared) / length)


def edit_sketch(name: Column) -> Column:
    """``(n, low, high)``: the length, and a run of bits per letter, one for each time it occurs up to three
    (digits four)."""
    longs, at = [F.lit(0).cast("long")] * 2, 0
    for letter in LETTERS:
        width = 4 if letter.isdigit() else 3
        if at < 64 < at + width:
            at = 64
        times = F.length(name) - F.length(F.replace(name, F.lit(letter), F.lit("")))
        run = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(times, F.lit(width))) - F.lit(1)
        longs[at // 64] = longs[at // 64].bitwiseOR(F.shiftleft(run, at % 64))
        at += width
    return F.named_struct(F.lit("n"), F.length(name), F.lit("low"), longs[0], F.lit("high"), longs[1])


def _surplus(left: str, right: str) -> Column:
    """How many bits of the left sketch the right one lacks."""
    parts = [F.col(f"{left}.{k}").bitwiseAND(F.bitwise_not(F.col(f"{right}.{k}"))) for k in ("low", "high")]
    return F.bit_count(parts[0]) + F.bit_count(parts[1])


def edit_bound(left: str, right: str) -> Column:
    """The edit similarity that two names could reach at most, from their sketches.

    One edit takes at most one character out of a name and puts at most one in, so every surplus bit of
    either side costs an edit of its own.
    """
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    longest = F.greatest(n, m)
    edits = F.greatest(_surplus(left, right), _surplus(right, left), longest - F.least(n, m))
    return F.coalesce(F.try_divide(longest - edits, longest), F.lit(1.0))


def sketch_bound(left: str, right: str) -> Column:
    """``ratio_bound`` from sketches: never below it, and quick enough for every pair of a common token."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    shared = F.least(n - _surplus(left, right), m - _surplus(right, left))
    return F.coalesce(F.try_divide(F.lit(2.0) * shared, n + m), F.lit(1.0))


def _fuzzy_postings(
    names: DataFrame, registry: DataFrame, letters: Callable[[Column], Column] = letter_counts
) -> tuple[DataFrame, DataFrame]:
    """Distinct registry names by token, long lists cut into chunks, and the chunk counts.

    ``ANY_TOKEN`` lists all names of a state: a listing name without any distinctive token is
    compared with every one of them.  Only states with such a listing name get that list.
    """
    bare = cut_lineage(names.filter(F.size("tokens") == 0).select("state").distinct())
    bare = broadcast_if_few(bare.withColumn("bare", F.lit(True)))
    candidates = registry.groupBy("state", "norm", F.col("tokens").alias("r_tokens")).agg(
        F.min(F.struct("r_order", "code")).alias("first")
    ).withColumn("r_letters", letters(F.col("norm"))).join(bare, "state", "left")
    listed = F.when(F.col("bare"), F.array_append("r_tokens", F.lit(ANY_TOKEN)))
    postings = candidates.select(
        "state",
        F.explode(listed.otherwise(F.col("r_tokens"))).alias("token"),
        F.col("norm").alias("r_norm"),
        "r_letters",
        "r_tokens",
        "first",
    )
    long_lists = _long_lists(postings, ["state", "token"])
    return _cut(postings, long_lists, ["state", "token"], "r_norm"), long_lists


def fuzzy_pairs(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Each distinct listing name with each distinct registry name it may be compared with, once:
    ``state, norm, tokens, letters, chunk, r_norm, r_letters, first``."""
    names = listing.select("state", "norm", "tokens").distinct()
    names = names.withColumn("letters", letter_counts(F.col("norm")))
    postings, long_lists = _fuzzy_postings(names, registry)
    wanted = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(ANY_TOKEN)))
    probes = _spread(names.withColumn("token", F.explode(wanted)), long_lists, ["state", "token"])
    once = (F.col("token") == ANY_TOKEN) | (
        F.array_min(F.array_intersect("tokens", "r_tokens")) == F.col("token")
    )
    return probes.join(by_shuffle(postings), ["state", "token", "chunk"]).filter(once).drop("token", "r_tokens")


def _name_probes(
    names: DataFrame, registry: DataFrame
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``(state, norm, known, unknown, letters)``: the tokens of a name that the registry knows in its state, the
    rarest first, how many others it has, and its sketch. And a function that joins rows of names, each with one
    ``token`` of theirs, with the registry names that hold it.
    """
    keys = ["state", "token"]
    postings, long_lists = _fuzzy_postings(names, registry, edit_sketch)
    postings = cut_lineage(postings)
    wanted = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(ANY_TOKEN)))
    sizes = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # Tokens are those of the normal name, so a name has one set of them.
    known = cut_lineage(
        names.select("state", "norm", F.size("tokens").alias("width"), F.explode(wanted).alias("token"))
        .join(by_shuffle(sizes), keys).groupBy("state", "norm")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("known"), F.max("width").alias("width"))
        .select(
            "state", "norm", "known", F.greatest(F.col("width") - F.size("known"), F.lit(0)).alias("unknown"),
            edit_sketch(F.col("norm")).alias("letters"),
        )
    )

    def meet(probes: DataFrame) -> DataFrame:
        return _spread(probes, long_lists, keys).join(by_shuffle(postings), [*keys, "chunk"])

    return known, meet


def edit_pairs(listing: DataFrame, registry: DataFrame, floor: float = 0.0) -> DataFrame:
    """The pairs of ``fuzzy_pairs`` that can have the best edit similarity of their listing name, if that is
    ``floor`` or more: ``state, norm, r_norm, first``.

    Some names at the rarest token of a name give a score that is reached. A pair that is as good has at
    most ``room`` edits; an edit spoils two tokens at most, so such a pair shares one of the ``2 * room + 1``
    rarest. No pair is kept, sorted or scored before its sketches allow that score.
    """
    names = listing.select("state", "norm", "tokens").distinct()
    if floor > 0:
        names = names.filter(F.length("norm") > 0)  # an empty name reaches no floor, not even with another one
    known, meet = _name_probes(names, registry)
    rarest = F.col("known")[0]
    step = F.ceil(rarest["n"] / FIRST_TRIES)
    tried = meet(known.select("state", "norm", rarest["token"].alias("token"), step.alias("step"))).filter(
        F.pmod(F.xxhash64("r_norm"), F.col("step")) == 0
    )
    score = levenshtein_ratio(F.col("norm"), F.col("r_norm"))
    reached = tried.groupBy("state", "norm").agg(F.max(score).alias("reached"))
    reach = F.greatest(F.coalesce("reached", F.lit(0.0)), F.lit(float(floor)))
    room = F.floor((F.try_divide(F.lit(1.0), F.col("reach")) - 1) * F.col("letters.n") + 1e-6)
    probes = known.join(by_shuffle(reached), ["state", "norm"], "left").withColumn("reach", reach).withColumn(
        "room", F.coalesce(room, F.lit(2**40))
    ).withColumn(
        "tokens", F.slice("known.token", F.lit(1), F.least(F.size("known"), 2 * F.col("room") + 1).cast("int"))
    ).select("state", "norm", "letters", "reach", "room", "tokens", F.explode("tokens").alias("token"))
    # The cheapest tests come first: most pairs of a common token end there.
    fits = (F.col("letters.n") - F.col("r_letters.n") <= F.col("room")) & (
        F.col("r_letters.n") - F.col("letters.n") <= F.col("room")
    ) & (_surplus("letters", "r_letters") <= F.col("room")) & (_surplus("r_letters", "letters") <= F.col("room"))
    once = (F.col("token") == ANY_TOKEN) | (
        F.array_min(F.array_intersect("tokens", "r_tokens")) == F.col("token")
    )
    possible = edit_bound("letters", "r_letters") >= F.col("reach")
    near = meet(probes).filter(fits & possible & once)
    return near.select("state", "norm", "r_norm", "first")


def best_first(pairs: DataFrame) -> DataFrame:
    """``(state, norm, r_order, code, score, scored)``: the best pair of each name and chunk.

    ``pairs`` needs ``bound``. The pairs of a name are read best bound first, from a sort, and a pair is
    scored only while its bound could still win; ``scored`` counts those.
    """
    kind = "state string, norm string, r_order long, code string, score double, scored long"
    rows = pairs.select(
        "state", "norm", "chunk", "bound", "r_norm", F.col("first.r_order").cast("long").alias("r_order"), "first.code"
    )
    ordered = rows.repartition("state", "norm", "chunk").sortWithinPartitions(
        "state", "norm", "chunk", F.desc("bound"), "r_order"
    )

    def score(batches):  # noqa: ANN001, ANN202  (nested, so that it travels to the workers by value)
        matcher, now, best, scored = SequenceMatcher(None), None, (0.0, 0, None), 0
        for batch in batches:
            out = []
            for state, norm, chunk, bound, r_norm, r_order, code in batch.itertuples(index=False, name=None):
                if (state, norm, chunk) != now:
                    if scored:
                        out.append((*now[:2], -best[1], best[2], best[0], scored))
                    now, best, scored = (state, norm, chunk), (0.0, 0, None), 0
                    matcher.set_seq1(norm)
                if scored and (bound, -r_order) <= best[:2]:
                    continue
                matcher.set_seq2(r_norm)
                if scored and (matcher.quick_ratio(), -r_order) <= best[:2]:  # by all letter counts, at less cost
                    continue
                scored += 1
                ratio = matcher.ratio()
                if (ratio, -r_order) > best[:2] or best[2] is None:
                    best = (ratio, -r_order, code)
            yield pd.DataFrame(out, columns=["state", "norm", "r_order", "code", "score", "scored"])
        if scored:
            yield pd.DataFrame(
                [(*now[:2], -best[1], best[2], best[0], scored)],
                columns=["state", "norm", "r_order", "code", "score", "scored"],
            )

    return ordered.mapInPandas(score, kind)


def best_ratios(listing: DataFrame, registry: DataFrame, floor: float = 0.0) -> DataFrame:
    """Scored pairs of ``fuzzy_pairs``, the best of each listing name among them if that is ``floor`` or more:
    ``state, norm, r_order, code, score``.

    Names at the rarest token of a name are scored first, and the best of them is a score that is reached. In
    a pair that is as good the matched blocks leave few characters out. One of the listing name spoils two tokens
    at most (a blank), one of the registry name a single token; tokens that the registry does not know are spoilt
    in any case. So such a pair shares one of the ``spoilt + 1`` rarest, and only pairs are kept, sorted and scored
    whose sketches and edits allow the score reached.
    """
    names = listing.select("state", "norm", "tokens").distinct()
    known, meet = _name_probes(names, registry)
    rarest = F.col("known")[0]
    known = known.withColumn("rarest", rarest["token"]).withColumn("step", F.ceil(rarest["n"] / FIRST_TRIES))
    chosen = F.pmod(F.xxhash64("r_norm"), F.col("step")) == 0
    possible = sketch_bound("letters", "r_letters")

    def scored(pairs: DataFrame) -> DataFrame:
        return best_first(pairs.withColumn("bound", possible)).drop("scored")

    tried = meet(known.select("state", "norm", "letters", "step", F.col("rarest").alias("token"))).filter(
        chosen & (possible >= floor)
    )
    first = F.max(F.struct("score", (-F.col("r_order")).alias("_order"), "code")).alias("first")
    reached = cut_lineage(scored(tried).groupBy("state", "norm").agg(first))

    n, reach = F.col("letters.n"), F.col("reach")
    left_out = F.greatest(F.try_divide(2 - 2 * reach, reach), (4 - 4 * reach) / (2 - reach))
    spoilt = F.coalesce(F.floor(left_out * n + 1e-6), F.lit(2**40))
    # All names at a rarest token that is held by few have been tried.
    skipped = F.when(F.col("step") == 1, 1).otherwise(0)
    length = F.least(F.size("known").cast("long"), spoilt - F.col("unknown") + 1) - skipped
    probes = known.join(by_shuffle(reached), ["state", "norm"], "left").withColumn(
        "reach", F.greatest(F.coalesce("first.score", F.lit(0.0)), F.lit(float(floor)))
    ).withColumn(
        "tokens", F.slice("known.token", skipped + 1, F.greatest(length, F.lit(0)).cast("int"))
    ).select("state", "norm", "letters", "reach", "rarest", "step", "tokens", F.explode("tokens").alias("token"))
    # The cheapest test comes first: most pairs of a common token end there.
    m = F.col("r_letters.n")
    fits = 2 * F.least(n, m) + 1e-6 >= reach * (n + m)
    once = (F.col("token") == ANY_TOKEN) | (
        F.array_min(F.array_intersect("tokens", "r_tokens")) == F.col("token")
    )
    before = ((F.col("rarest") == ANY_TOKEN) | F.array_contains("r_tokens", F.col("rarest"))) & chosen
    # Matched blocks stand in the same order in both names, so edits bound them too: letters alone let anagrams pass.
    alike = F.try_divide(F.lit(1.0) * (n + m - F.levenshtein("norm", "r_norm")), n + m)
    in_order = F.coalesce(alike, F.lit(1.0)) >= reach
    others = meet(probes).filter(fits & (possible >= reach) & once & ~before & in_order)
    tried_best = reached.select("state", "norm", (-F.col("first._order")).alias("r_order"), "first.code", "first.score")
    return tried_best.unionByName(scored(others))


def best_fuzzy(
    listing: DataFrame, registry: DataFrame, method: str = "difflib", floor: float = 0.0
) -> DataFrame:
    """``(state, norm, best_code, best_score)``: the most similar candidate of each listing name.

    Candidates share a distinctive token, if the listing name has one.  The first candidate
    in registry order wins a tie; a score of zero is no candidate.  Pairs that cannot reach
    ``floor`` are not scored, which changes no score of ``floor`` or more.
    """
    if method == "difflib":
        scored = best_ratios(listing, registry, floor)
    else:
        scored = edit_pairs(listing, registry, floor).select(
            "state", "norm", "first.r_order", "first.code",
            SIMILARITY[method](F.col("norm"), F.col("r_norm")).alias("score"),
        )
    best = F.max(F.struct("score", (-F.col("r_order")).alias("_order"), "code"))
    return (
        scored.filter("score > 0")
        .groupBy("state", "norm")
        .agg(best.alias("best"))
        .select(
            "state", "norm", F.col("best.code").alias("best_code"),
            F.col("best.score").alias("best_score"),
        )
    )


def link_fuzzy(
    listing: DataFrame,
    registry: DataFrame,
    threshold: float = FUZZY_THRESHOLD,
    method: str = "difflib",
) -> DataFrame:
    """Stage 6, the best similarity reaches the threshold."""
    best = best_fuzzy(listing, registry, method, floor=threshold)
    return listing.join(by_shuffle(best), ["state", "norm"]).filter(F.col("best_score") >= threshold).select(
        "l_id",
        F.col("best_code").alias("code"),
        F.lit("fuzzy").alias("method"),
        F.bround("best_score", 3).alias("score"),
    )


def crosswalk(
    listing: DataFrame,
    registry: DataFrame,
    overrides: DataFrame,
    fuzzy: float = FUZZY_THRESHOLD,
    method: str = "difflib",
    unmatched_scores: bool = True,
) -> DataFrame:
    """The whole cascade on prepared inputs: one row per listing row.

    ``(l_id, l_name, state, code, method, score)``.  The first stage that decides wins.
    Unmatched rows carry their best similarity as a hint; without ``unmatched_scores`` pairs
    that cannot reach the threshold are skipped, codes and methods stay the same, and that
    hint may be lower or null.
    The early decisions feed the fuzzy stage and the result, so that slim table is
    checkpointed instead of being computed again.
    """
    none = F.lit(None)
    decisions = overrides.select("name_key", "state", F.col("code").alias("override_code"))
    blocks = registry.select("state").distinct().withColumn("has_block", F.lit(True))
    joined = (
        listing.join(by_shuffle(decisions), ["name_key", "state"], "left")
        .join(blocks, "state", "left")
        .join(by_shuffle(_evidence_by_class(listing, registry)), ZIP_CLASS, "left")
        .join(by_shuffle(_exact_index(registry)), ["state", "norm"], "left")
        .join(by_shuffle(_containment_by_class(listing, registry)), ["state", "tokens"], "left")
    )

    def outcome(code: Column, name: str, score: Column = none) -> Column:
        return F.struct(
            code.cast("string").alias("code"), F.lit(name).alias("method"),
            score.cast("double").alias("score"),
        )

    early = (
        F.when(F.col("override_code").isNotNull(), outcome(F.col("override_code"), "override"))
        .when(F.col("has_block").isNull(), outcome(none, "unmatched:no-candidates-in-state"))
        .when(F.col("only"), outcome(F.col("top_code"), "zip+token"))
        .when(F.col("top_n") == 1, outcome(F.col("top_code"), "zip+token:multi", _token_share()))
        .when(F.col("exact_code").isNotNull(), outcome(F.col("exact_code"), "exact-name"))
        .when(
            F.col("contain_code").isNotNull(),
            outcome(F.col("contain_code"), "distinctive-token", F.lit(1.0)),
        )
    )
    staged = cut_lineage(
        joined.select(
            "l_id", "l_name", "state", "norm", "tokens", early.alias("early"),
            (F.col("top_n") > 1).alias("ambiguous"),
        )
    )
    floor = 0.0 if unmatched_scores else fuzzy
    best = best_fuzzy(staged.filter("early is null"), registry, method, floor)
    late = (
        F.when(
            F.col("best_score") >= fuzzy,
            outcome(F.col("best_code"), "fuzzy", F.bround("best_score", 3)),
        )
        .when(F.col("ambiguous"), outcome(none, "unmatched:ambiguous-at-zip"))
        .otherwise(outcome(none, "unmatched", F.bround("best_score", 3)))
    )
    decided = staged.filter("early is not null").select("l_id", "l_name", "state", "early.*")
    open_rows = staged.filter("early is null").join(by_shuffle(best), ["state", "norm"], "left")
    return decided.unionByName(
        open_rows.select("l_id", "l_name", "state", late.alias("late")).select(
            "l_id", "l_name", "state", "late.*"
        )
    )


# --- reports ----------------------------------------------------------------

def match_report(matches: DataFrame) -> DataFrame:
    """One row: total, matched and rate; the rate of an empty listing is 0."""
    return matches.agg(
        F.count(F.lit(1)).alias("total"), F.count("code").alias("matched")
    ).withColumn("rate", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def matches_by_method(matches: DataFrame) -> DataFrame:
    """Matched rows per stage, most frequent first."""
    matched = matches.filter(F.col("code").isNotNull())
    counts = matched.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "method")


def unmatched_rows(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("code").isNull()).select(
        F.col("l_name").alias("name"), "state", F.col("score").alias("best_score")
    )


def collisions(matches: DataFrame) -> DataFrame:
    """Listing rows that share a code with another one: ``(code, claims, l_name, method)``.

    One row per claimant, so a code claimed by very many rows is not gathered anywhere.
    """
    claims = (
        matches.filter(F.col("code").isNotNull())
        .groupBy("code").agg(F.count(F.lit(1)).alias("claims")).filter("claims > 1")
    )
    return matches.join(by_shuffle(claims), "code").select("code", "claims", "l_name", "method")


def weak_matches(matches: DataFrame, registry: DataFrame, max_df: float = GENERIC_TOKEN_MAX_DF,
                 code: str = "code", name: str = "name") -> DataFrame:
    """Matches whose two names share no distinctive token: the ones a person should read."""
    generic = _generic_array(registry, name, max_df)
    names = registry.select(F.col(code).alias("code"), F.col(name).alias("r_name"))
    pairs = matches.filter(F.col("code").isNotNull()).join(by_shuffle(names), "code")
    shared = F.array_except(
        F.array_intersect(distinct_tokens("l_name"), distinct_tokens("r_name")), generic
    )
    return pairs.filter(F.size(shared) == 0).select("l_id", "l_name", "r_name", "code", "method")
