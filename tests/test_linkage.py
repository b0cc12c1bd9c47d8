import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rosterline.constants import ABBREVIATIONS, STOPWORDS
from rosterline.operators import linkage

REGISTRY = "code string, name string, state string, zip string, r_order long"
LISTING = "l_id long, name string, state string, zip string"
OVERRIDES = "name_key string, state string, code string"


def run(spark, listing, registry, overrides=(), max_df=0.05, **kwargs):
    left, right = linkage.prepare(
        spark.createDataFrame(listing, LISTING), spark.createDataFrame(registry, REGISTRY), max_df
    )
    decided = spark.createDataFrame(list(overrides), OVERRIDES)
    rows = linkage.crosswalk(left, right, decided, **kwargs).collect()
    assert len(rows) == len(listing) == len({r.l_id for r in rows})
    return {r.l_id: (r.code, r.method, r.score) for r in rows}


def tokens(name):
    words = [ABBREVIATIONS.get(w, w) for w in re.split(r"[\W_]+", name.upper()) if w]
    return [w for w in words if w not in STOPWORDS]


def brute_force(listing, registry, overrides, max_df, similarity):
    """Every stage by comparing all pairs, written from the rules."""
    generic = {
        t for t, n in Counter(t for r in registry for t in set(tokens(r[1]))).items() if n / len(registry) > max_df
    }
    decided = {(k, s): c for k, s, c in overrides}
    block = defaultdict(list)
    for code, name, state, zip_code, order in registry:
        block[state.upper()].append((order, code, " ".join(tokens(name)), set(tokens(name)) - generic, zip_code))
    result = {}
    for l_id, name, state, zip_code in listing:
        key = state.strip().upper()
        mine, norm = set(tokens(name)) - generic, " ".join(tokens(name))
        if (name.strip().upper(), key) in decided:
            result[l_id] = (decided[name.strip().upper(), key], "override", None)
            continue
        if key not in block:
            result[l_id] = (None, "unmatched:no-candidates-in-state", None)
            continue
        candidates = sorted(block[key])
        near = sorted((len(c[3] & mine) for c in candidates if c[4] == zip_code and c[3] & mine), reverse=True)
        best_near = [c for c in candidates if c[4] == zip_code and near and len(c[3] & mine) == near[0]]
        same_name = [c for c in candidates if c[2] == norm]
        holding = [c for c in candidates if mine and mine <= c[3]]
        if len(near) == 1:
            result[l_id] = (best_near[0][1], "zip+token", None)
        elif len(near) > 1 and len(best_near) == 1:
            result[l_id] = (best_near[0][1], "zip+token:multi", round(near[0] / len(mine), 3))
        elif same_name:
            result[l_id] = (same_name[0][1], "exact-name", None)
        elif len(holding) == 1:
            result[l_id] = (holding[0][1], "distinctive-token", 1.0)
        else:
            scores = [(similarity(norm, c[2]), -c[0], c[1]) for c in candidates if not mine or c[3] & mine]
            score, _, code = max(scores, default=(0.0, 0, None))
            if score >= 0.84:
                result[l_id] = (code, "fuzzy", round(score, 3))
            elif near:
                result[l_id] = (None, "unmatched:ambiguous-at-zip", None)
            else:
                result[l_id] = (None, "unmatched", round(score, 3) if score > 0 else None)
    return result


def difflib_similarity(a, b):
    return SequenceMatcher(None, a, b).ratio()


PLACES = ["WEBB", "KARNES", "BROOKS", "LUBBOCK", "POLK", "ESSEX", "OTERO", "TORRANCE", "EL PASO", "CALHOUN"]


def random_case(seed, extra=()):
    rng = random.Random(seed)
    kinds = ["County Jail", "Detention Center", "County Det Ctr", "Processing Center", "Correctional Facility"]

    def name():
        words = [rng.choice(PLACES).title() for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        return " ".join([*words, rng.choice(kinds), rng.choice(["", "", "North", "East", "Annex"])]).strip()

    registry = [(f"C{i:03d}", name(), rng.choice(["TX", "NM"]), rng.choice(["78001", "78002", "78003"]), i) for i in range(60)]
    registry += list(extra)
    listing = []
    for i in range(80):
        base = rng.choice(registry)
        text = rng.choice([base[1], base[1].upper(), base[1] + " (CCA)", base[1].replace("e", "ee", 1), name()])
        listing.append((i, text, rng.choice([base[2], " tx ", "ZZ"]), rng.choice([base[3], "99999"])))
    return listing, registry


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cascade_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(linkage, "POSTING_CHUNK", 4)
    long_name = " ".join(f"Unit{i}" for i in range(11)) + " Webb Karnes"
    extra = [("L1", long_name, "TX", "78001", 60), ("L2", long_name + " Polk", "TX", "78001", 61)]
    listing, registry = random_case(seed, extra)
    listing += [(900, long_name, "TX", "78001"), (901, "Unit1 Unit2 Karnes", "TX", "78001"),
                (902, long_name + " Polk", "TX", "11111"), (903, "County Jail", "TX", "78001")]
    overrides = [(listing[0][1].strip().upper(), listing[0][2].strip().upper(), "X1")]
    expected = brute_force(listing, registry, overrides, 0.12, difflib_similarity)
    got = run(spark, listing, registry, overrides, max_df=0.12)
    assert got == {k: (v[0], v[1], pytest.approx(v[2]) if v[2] is not None else None) for k, v in expected.items()}


def test_skipping_hopeless_pairs_changes_no_decision(spark):
    listing, registry = random_case(9)
    full = run(spark, listing, registry, max_df=0.12)
    lean = run(spark, listing, registry, max_df=0.12, unmatched_scores=False)
    assert {k: v[:2] for k, v in full.items()} == {k: v[:2] for k, v in lean.items()}


def test_similarity_is_taken_in_listing_registry_order(spark):
    df = spark.createDataFrame([("LUBBOCK COUNTY DETENTION CENTER", "BROOKS COUNTY DETENTION CENTER")], "a string, b string")
    row = df.select(linkage.difflib_ratio("a", "b").alias("ab"), linkage.difflib_ratio("b", "a").alias("ba")).first()
    assert row.ab == difflib_similarity("LUBBOCK COUNTY DETENTION CENTER", "BROOKS COUNTY DETENTION CENTER")
    assert row.ab >= 0.84


def test_letter_bound_is_never_below_the_similarity(spark):
    rng = random.Random(4)
    names = ["", "A", "ÄÖ 9", "9 ÖÄ", *("".join(rng.choices("ABCDE 12Ü-", k=rng.randint(1, 40))) for _ in range(60))]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    bound = linkage.ratio_bound(linkage.letter_counts(F.col("a")), linkage.letter_counts(F.col("b")))
    rows = df.select("a", "b", bound.alias("bound")).collect()
    assert all(r.bound >= difflib_similarity(r.a, r.b) for r in rows)
    assert sum(r.bound < 0.84 for r in rows) > len(rows) / 2


def test_best_first_scores_few_pairs(spark):
    listing, registry = random_case(5)
    left, right = linkage.prepare(spark.createDataFrame(listing, LISTING), spark.createDataFrame(registry, REGISTRY), 0.3)
    pairs = linkage.fuzzy_pairs(left, right)
    bounded = pairs.withColumn("bound", linkage.ratio_bound(F.col("letters"), F.col("r_letters"))).cache()
    best = {}
    for r in bounded.collect():
        score = (difflib_similarity(r.norm, r.r_norm), -r.first.r_order)
        best[r.state, r.norm] = max(best.get((r.state, r.norm), (-1, 0)), score)
    rows = linkage.best_first(bounded).collect()
    got = {}
    for r in rows:
        got[r.state, r.norm] = max(got.get((r.state, r.norm), (-1, 0)), (r.score, -r.r_order))
    assert got == best
    assert sum(r.scored for r in rows) < bounded.count() / 2


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    longest = max(len(a), len(b))
    return (longest - row[-1]) / longest if longest else 1.0


def test_edit_bound_is_never_below_the_similarity(spark):
    rng = random.Random(8)
    names = ["", "A", "ÄÖ 9", "AAAAA 99999", *("".join(rng.choices("ABYZ 129Ü-", k=rng.randint(1, 30))) for _ in range(50))]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    df = df.select("a", "b", linkage.edit_sketch(F.col("a")).alias("s"), linkage.edit_sketch(F.col("b")).alias("t"))
    rows = df.select("a", "b", linkage.edit_bound("s", "t").alias("bound")).collect()
    assert all(r.bound >= edit_similarity(r.a, r.b) for r in rows)
    assert sum(r.bound < 0.84 for r in rows) > len(rows) / 2


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_edit_cascade_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(linkage, "POSTING_CHUNK", 4)
    monkeypatch.setattr(linkage, "FIRST_TRIES", 2)
    listing, registry = random_case(seed)
    listing += [(900, "Webb Karnes Polk Essex Oterro", "TX", "1"), (901, "El Pazo County Jail", "NM", "1"),
                (902, "County Jail", "TX", "1"), (903, None, "TX", "1"), (904, "WebbKarnes Jail", "TX", "1")]
    expected = brute_force([r for r in listing if r[1]], registry, [], 0.12, edit_similarity)
    got = run(spark, listing, registry, max_df=0.12, method="levenshtein")
    got.pop(903)
    assert got == {k: (v[0], v[1], pytest.approx(v[2]) if v[2] is not None else None) for k, v in expected.items()}


@pytest.mark.parametrize("floor", [0.0, 0.84])
def test_a_common_token_alone_makes_few_edit_pairs(spark, floor):
    rng = random.Random(3)
    words = ["".join(rng.choices("ABCDEFGHIJKLMNOPRSTUVWXYZ", k=9)) for _ in range(150)]
    registry = [(f"H{i:03d}", f"Hub {w}", "TX", "1", i) for i, w in enumerate(words)]
    listing = [(i, f"Hub {w} {w[::-1][:1]}", "TX", "2") for i, w in enumerate(words)]
    left, right = linkage.prepare(spark.createDataFrame(listing, LISTING), spark.createDataFrame(registry, REGISTRY), 1.1)
    pairs = linkage.edit_pairs(left, right, floor).collect()
    assert {(r.norm.split()[1], r.r_norm.split()[1]) for r in pairs} >= {(w, w) for w in words}
    assert len(pairs) < 3 * len(words) < linkage.fuzzy_pairs(left, right).count() / 10


def test_sketch_bound_is_never_below_the_similarity(spark):
    rng = random.Random(6)
    names = ["", "A", "ÄÖ 9", "AAAAA 99999", *("".join(rng.choices("ABYZ 129Ü-", k=rng.randint(1, 30))) for _ in range(50))]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    df = df.select("a", "b", linkage.edit_sketch(F.col("a")).alias("s"), linkage.edit_sketch(F.col("b")).alias("t"))
    rows = df.select("a", "b", linkage.sketch_bound("s", "t").alias("bound")).collect()
    assert all(r.bound >= difflib_similarity(r.a, r.b) for r in rows)
    assert sum(r.bound < 0.84 for r in rows) > len(rows) / 4


@pytest.mark.parametrize("floor, tries", [(0.0, 2), (0.84, 200)])
def test_best_ratios_equal_brute_force(spark, monkeypatch, floor, tries):
    monkeypatch.setattr(linkage, "POSTING_CHUNK", 4)
    monkeypatch.setattr(linkage, "FIRST_TRIES", tries)
    listing, registry = random_case(21)
    rng = random.Random(22)
    glued = [r[1].replace(" ", "", 1) for r in registry[:20]]
    cut = [r[1][:k] + rng.choice([" ", "x", ""]) + r[1][k + 1:] for r in registry[20:] for k in [rng.randrange(1, len(r[1]))]]
    listing += [(500 + i, name, "TX", "1") for i, name in enumerate([*glued, *cut, "The", "County Jail", "Webb"])]
    registry += [("E1", "The", "TX", "1", 90), ("E2", "WebbKarnes Polk Polk", "TX", "1", 91)]
    generic = {
        t for t, n in Counter(t for r in registry for t in set(tokens(r[1]))).items() if n / len(registry) > 0.12
    }
    expected = {}
    for _, name, state, _ in listing:
        mine, norm = set(tokens(name)) - generic, " ".join(tokens(name))
        scores = [
            (difflib_similarity(norm, " ".join(tokens(r[1]))), -r[4], r[0])
            for r in registry
            if r[2] == state.strip().upper() and (not mine or mine & set(tokens(r[1])) - generic)
        ]
        score, _, code = max(scores, default=(0.0, 0, None))
        if score > 0 and score >= floor:
            expected[state.strip().upper(), norm] = (code, score)
    left, right = linkage.prepare(spark.createDataFrame(listing, LISTING), spark.createDataFrame(registry, REGISTRY), 0.12)
    best = linkage.best_fuzzy(left, right, "difflib", floor).filter(F.col("best_score") >= floor).collect()
    assert {(r.state, r.norm): (r.best_code, r.best_score) for r in best} == expected


@pytest.mark.parametrize("floor", [0.0, 0.84])
def test_a_common_token_alone_makes_few_ratio_pairs(spark, monkeypatch, floor):
    rng = random.Random(3)
    words = ["".join(rng.choices("ABCDEFGHIJKLMNOPRSTUVWXYZ", k=9)) for _ in range(150)]
    registry = [(f"H{i:03d}", f"Hub North {w}", "TX", "1", i) for i, w in enumerate(words)]
    listing = [(i, f"Hub North {w} {w[::-1][:1]}", "TX", "2") for i, w in enumerate(words)]
    left, right = linkage.prepare(spark.createDataFrame(listing, LISTING), spark.createDataFrame(registry, REGISTRY), 1.1)
    sorted_pairs, best_first = [], linkage.best_first
    monkeypatch.setattr(linkage, "best_first", lambda pairs: sorted_pairs.append(pairs.count()) or best_first(pairs))
    best = linkage.best_fuzzy(left, right, "difflib", floor).collect()
    assert {(r.norm.split()[2], r.best_code) for r in best} == {(w, f"H{i:03d}") for i, w in enumerate(words)}
    assert len(words) <= sum(sorted_pairs) < 2 * len(words)


@pytest.mark.parametrize("names", [6, 7])
def test_empty_names_link_by_ratio_whichever_name_is_tried_first(spark, monkeypatch, names):
    monkeypatch.setattr(linkage, "FIRST_TRIES", 1)
    registry = [("E", "The", "TX", "1", 0), *((f"C{i}", f"Alpha{i} Jail", "TX", "1", i) for i in range(1, names))]
    left, right = linkage.prepare(
        spark.createDataFrame([(1, "The", "TX", "1")], LISTING), spark.createDataFrame(registry, REGISTRY), 1.1
    )
    found = linkage.link_fuzzy(left, right).collect()
    assert [(r.l_id, r.code, r.score) for r in found] == [(1, "E", 1.0)]


def test_anagrams_of_a_name_are_not_scored(spark, monkeypatch):
    rng = random.Random(5)
    mixed = ["".join(rng.sample("ABCDEFGHIJKLMNOP", 16)) for _ in range(40)]
    registry = [("R", "Hub Near ABCDEFGHIJKLMNOP Qrstuvw", "TX", "1", 0)]
    registry += [(f"M{i}", f"Hub Raen {w} Qrstuvw", "TX", "1", i + 1) for i, w in enumerate(mixed)]
    listing = [(1, "Hub Near ABCDEFGHIJKLMNOP", "TX", "2")]
    left, right = linkage.prepare(spark.createDataFrame(listing, LISTING), spark.createDataFrame(registry, REGISTRY), 1.1)
    sorted_pairs, best_first = [], linkage.best_first
    monkeypatch.setattr(linkage, "best_first", lambda pairs: sorted_pairs.append(pairs.count()) or best_first(pairs))
    best = linkage.best_fuzzy(left, right, "difflib").collect()
    assert [(r.best_score, r.best_code) for r in best] == [(difflib_similarity(listing[0][1].upper(), registry[0][1].upper()), "R")]
    assert sum(sorted_pairs) < 5


def test_empty_names_do_not_link_by_edits(spark):
    listing, registry = [(1, "The", "TX", "1"), (2, "Alpha Jail", "TX", "1")], [("A", "The", "TX", "1", 1), ("B", "Alpha Jail", "TX", "2", 2)]
    left, right = linkage.prepare(spark.createDataFrame(listing, LISTING), spark.createDataFrame(registry, REGISTRY), 1.1)
    assert left.filter("norm = ''").count() == 1
    found = linkage.link_fuzzy(left, right, method="levenshtein").collect()
    assert [(r.l_id, r.code, r.score) for r in found] == [(2, "B", 1.0)]


def test_hot_tokens_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "POSTING_CHUNK", 3)
    registry = [(f"H{i:02d}", f"Hub Unit{i} Wing{i % 4}", "TX", "1", i) for i in range(30)]
    rows = [(1, "Hub Wing1 Unit5", "TX", "1"), (2, "Hub Wing2", "TX", "1"), (3, "Hub", "TX", "2"), (4, "Hub Unit7", "TX", "2")]
    got = run(spark, rows, registry, max_df=1.1, unmatched_scores=False)
    assert got[1] == ("H05", "zip+token:multi", 1.0)
    assert got[2][0] is None and got[4] == ("H07", "distinctive-token", 1.0) and got[3][0] is None


def padding(n=60):
    """Registry rows elsewhere, so that role words are generic and place words are not."""
    return [(f"Z{i}", f"Place{i} County Detention Center", "ZZ", "00000", 1000 + i) for i in range(n)]


def test_generic_word_alone_never_matches(spark):
    registry = [("LRD", "Laredo Processing Center", "TX", "78041", 0), ("WEB", "Corecivic Webb County Detention Center", "TX", "78046", 1)]
    got = run(spark, [(1, "WEBB COUNTY DETENTION CENTER (CCA)", "TX", "78041")], registry + padding())
    assert got[1][:2] != ("LRD", "zip+token")
    got = run(spark, [(1, "WEBB COUNTY DETENTION CENTER", "TX", "78041")], registry + padding())
    assert got[1] == ("WEB", "distinctive-token", 1.0)


def test_tie_at_zip_is_refused_unless_the_name_is_equal(spark):
    registry = [("K1", "Karnes County Correctional", "TX", "78118", 0), ("K2", "Karnes County Residential", "TX", "78118", 1),
                *[(f"R{i}", f"Town{i} Correctional Residential", "ZZ", "1", 50 + i) for i in range(9)]]
    rows = [(1, "KARNES COUNTY IMMIGRATION PROCESSING CENTER", "TX", "78118"), (2, "Karnes Co Residential", "TX", "78118")]
    got = run(spark, rows, registry + padding())
    assert got[1][0] is None and got[1][1] == "unmatched:ambiguous-at-zip"
    assert got[2][:2] == ("K2", "exact-name")


def test_high_similarity_needs_a_shared_distinctive_token(spark):
    registry = [("BRK", "Brooks County Detention Center", "TX", "78355", 0)]
    got = run(spark, [(1, "LUBBOCK COUNTY DETENTION CENTER", "TX", "79401")], registry + padding())
    assert got[1] == (None, "unmatched", None)


def test_name_without_distinctive_token_is_compared_with_all(spark):
    registry = [("A", "County Detention Centre", "TX", "1", 5), ("B", "County Detention Centers", "TX", "1", 3)]
    got = run(spark, [(1, "County Detention Center", "TX", "2")], registry + padding())
    assert got[1][0] in ("A", "B") and got[1][1] == "fuzzy"


def test_override_wins_even_without_candidates(spark):
    got = run(spark, [(1, " Lake Jail ", "qq", "1"), (2, "Lake Jail", "qq", "1")], padding(), [("LAKE JAIL", "QQ", "HUMAN")])
    assert got[1] == ("HUMAN", "override", None) and got[2] == ("HUMAN", "override", None)


def test_reports(spark):
    matches = spark.createDataFrame(
        [(1, "a", "TX", "C1", "exact-name", None), (2, "b", "TX", "C1", "fuzzy", 0.9), (3, "c", "TX", None, "unmatched", 0.4)],
        "l_id long, l_name string, state string, code string, method string, score double",
    )
    report = linkage.match_report(matches).first()
    assert (report.total, report.matched, round(report.rate, 3)) == (3, 2, 0.667)
    assert linkage.match_report(matches.limit(0)).first().rate == 0.0
    assert {(r.code, r.claims, r.l_name) for r in linkage.collisions(matches).collect()} == {("C1", 2, "a"), ("C1", 2, "b")}
    assert [tuple(r) for r in linkage.unmatched_rows(matches).collect()] == [("c", "TX", 0.4)]
