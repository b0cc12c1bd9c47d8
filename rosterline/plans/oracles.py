"""The catalogue queries as plain SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

from ..constants import (
    ABBREVIATIONS, COUNTY_SOURCE, PLACE_DESIGNATORS, PLACE_PREFIXES, PLACE_SOURCE,
    PRECISION_NOTES, ROLE_WORDS, STATE_SOURCE, STOPWORDS, UNPLACED_NOTE,
)

ORACLES: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _suppressed(count: str, t: int = 5) -> str:
    return f"""
        CASE WHEN {count} > 0 AND {count} < {t} THEN NULL ELSE CAST({count} AS BIGINT) END AS n,
        ({count} > 0 AND {count} < {t}) AS suppressed,
        CASE WHEN {count} > 0 AND {count} < {t} THEN {t} END AS lt"""


def _gated(column: str, q: float, digits: int) -> str:
    """Quantile of five values or more, rounded half to even on its decimal form."""
    exact = f"CAST(CAST(quantile_cont(CAST({column} AS DOUBLE), {q}) AS VARCHAR) AS DECIMAL(36, 18)) * {10 ** digits}"
    whole, rest = f"CAST(floor({exact}) AS BIGINT)", f"({exact} - floor({exact}))"
    up = f"CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND {whole} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN count({column}) >= 5 THEN ({whole} + {up}) / {10 ** digits}.0::DOUBLE END"


def _tokens(name: str) -> str:
    spelled = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in ABBREVIATIONS.items())
    dropped = ", ".join(_quote(w) for w in ("", *STOPWORDS))
    words = f"string_split_regex(upper({name}), '[^\\p{{L}}\\p{{N}}]+')"
    return (
        f"list_filter(list_transform({words}, lambda t: CASE t {spelled} ELSE t END), "
        f"lambda t: t NOT IN ({dropped}))"
    )


# --- stays ------------------------------------------------------------------

def _stays(key: str = "l_suppkey", windowed: bool = True) -> str:
    window = (
        "WHERE l_shipdate >= (SELECT CAST(CAST(max(l_shipdate) AS DATE) - 365 AS TIMESTAMP) FROM lineitem)"
        if windowed else ""
    )
    return f"""
    stays AS (
        SELECT *, CASE WHEN raw_age BETWEEN 0 AND 120 THEN raw_age END AS age,
               CASE WHEN raw_age BETWEEN 0 AND 17 THEN '0-17' WHEN raw_age BETWEEN 18 AND 24 THEN '18-24'
                    WHEN raw_age BETWEEN 25 AND 34 THEN '25-34' WHEN raw_age BETWEEN 35 AND 44 THEN '35-44'
                    WHEN raw_age BETWEEN 45 AND 54 THEN '45-54' WHEN raw_age BETWEEN 55 AND 64 THEN '55-64'
                    WHEN raw_age BETWEEN 65 AND 120 THEN '65+' END AS age_band,
               date_diff('second', book_in, book_out) / 86400.0::DOUBLE AS los_days
        FROM (
            SELECT {key} AS code, o_custkey AS person, o_orderdate AS book_in, l_shipdate AS book_out,
                   1930 + o_custkey % 75 AS birth_year,
                   CAST(year(o_orderdate) - (1930 + o_custkey % 75) AS BIGINT) AS raw_age,
                   l_returnflag AS gender, l_linestatus AS criminality,
                   o_orderpriority AS release_reason, o_orderstatus AS classification,
                   CASE WHEN l_discount > 0 THEN l_extendedprice END AS amount_set,
                   CASE WHEN l_discount > 0.05 THEN l_extendedprice END AS amount_posted
            FROM (SELECT * FROM lineitem {window}) JOIN orders ON l_orderkey = o_orderkey
        )
    )"""


STAYS = _stays()
DIMS = ("gender", "criminality", "release_reason", "classification")


def _long(columns: dict[str, str], source: str = "stays", key: str = "code") -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{dim}' AS dim, CAST({column} AS VARCHAR) AS value FROM {source} WHERE {column} IS NOT NULL"
        for dim, column in columns.items()
    )


ORACLES["q_profile_bands"] = f"""
WITH {STAYS}
SELECT code, age_band AS value, {_suppressed('count(*)')}
FROM stays WHERE age_band IS NOT NULL GROUP BY code, age_band"""

ORACLES["q_profile_stats"] = f"""
WITH {STAYS}
SELECT code, count(*) AS stays_in_window, {_suppressed('count(age)')},
       CASE WHEN count(age) >= 5 THEN round(quantile_cont(age, 0.5), 1) END AS age_median
FROM stays GROUP BY code"""

ORACLES["q_window_instant"] = """
SELECT event_type, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id
FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY event_type"""

ORACLES["q_profile_top_values"] = f"""
WITH {STAYS},
counts AS (
    SELECT code, n_name AS value, count(*) AS c
    FROM stays JOIN customer ON person = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY code, n_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY c DESC, value) AS rn FROM counts)
SELECT code, value, {_suppressed('c')} FROM ranked WHERE rn <= 5"""

ORACLES["q_profile_value_counts"] = f"""
WITH {STAYS}, long AS ({_long({d: d for d in DIMS})})
SELECT code, dim, value, {_suppressed('count(*)')} FROM long GROUP BY code, dim, value"""

ORACLES["q_profile_quantiles"] = f"""
WITH {STAYS},
long AS (
    SELECT code, 'los_days' AS measure, los_days AS v FROM stays
    UNION ALL SELECT code, 'amount_set', amount_set FROM stays
    UNION ALL SELECT code, 'amount_posted', amount_posted FROM stays)
SELECT code, measure, {_suppressed('count(v)')},
       CASE WHEN count(v) >= 5 THEN round(quantile_cont(v, 0.5), 4) END AS median,
       CASE WHEN count(v) >= 5 THEN round(quantile_cont(v, 0.9), 4) END AS p90
FROM long WHERE v IS NOT NULL GROUP BY code, measure"""

ORACLES["q_profile_two_level"] = f"""
WITH {STAYS},
people AS (SELECT code, person, min(amount_set) AS amount FROM stays WHERE person IS NOT NULL GROUP BY code, person),
per AS (
    SELECT code, count(*) AS p, count(amount) AS a, quantile_cont(amount, 0.5) AS m FROM people GROUP BY code)
SELECT code,
       CASE WHEN p BETWEEN 1 AND 4 THEN NULL ELSE p END AS unique_people,
       CASE WHEN a BETWEEN 1 AND 4 OR a = 0 THEN NULL ELSE a END AS people_with_amount,
       CASE WHEN a >= 5 THEN round(m, 4) END AS person_median,
       CASE WHEN a >= 5 AND p >= 5 THEN round_even(a / p, 3) END AS share
FROM per"""

ORACLES["q_distinct_people"] = f"""
WITH {_stays(windowed=False)}
SELECT code, count(DISTINCT person) AS unique_people FROM stays GROUP BY code"""

ORACLES["q_value_frequency"] = """
SELECT l_quantity AS amount, count(*) AS n,
       (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_quantity IS NOT NULL) AS records,
       (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem WHERE l_returnflag = 'A') AS median
FROM lineitem WHERE l_returnflag = 'A' AND l_quantity IS NOT NULL GROUP BY l_quantity"""

ORACLES["q_age_bands"] = f"""
WITH {_stays(windowed=False)}
SELECT age_band, count(*) AS events, CAST(sum(age) AS BIGINT) AS age_sum,
       CAST(sum(CAST(los_days AS BIGINT)) AS BIGINT) AS los_sum
FROM stays GROUP BY age_band"""

ORACLES["q_profile_full"] = f"""
WITH {STAYS},
people AS (SELECT code, person, min(amount_set) AS amount FROM stays WHERE person IS NOT NULL GROUP BY code, person),
per AS (SELECT code, count(*) AS p, count(amount) AS a FROM people GROUP BY code),
raw AS (
    SELECT code, 'age_known' AS value, count(age) AS c FROM stays GROUP BY code
    UNION ALL SELECT code, 'n_completed', count(los_days) FROM stays GROUP BY code
    UNION ALL SELECT code, 'n_set', count(amount_set) FROM stays GROUP BY code
    UNION ALL SELECT code, 'n_posted', count(amount_posted) FROM stays GROUP BY code
    UNION ALL SELECT code, 'unique_people', p FROM per
    UNION ALL SELECT code, 'people_with_recorded_set', a FROM per),
long AS ({_long({'age_bands': 'age_band', 'gender': 'gender', 'release_reason': 'release_reason',
                 'book_in_criminality': 'criminality', 'classification': 'classification',
                 'top_citizenship': 'birth_year'})}),
counts AS (SELECT code, dim, value, count(*) AS c FROM long GROUP BY code, dim, value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY code, dim ORDER BY c DESC, value) AS rn FROM counts)
SELECT code, 'stats' AS dim, 'stays_in_window' AS value, CAST(count(*) AS DOUBLE) AS n FROM stays GROUP BY code
UNION ALL SELECT code, 'stats', 'age_median', {_gated('age', 0.5, 1)} FROM stays GROUP BY code
UNION ALL SELECT code, 'stats', 'los_median', {_gated('los_days', 0.5, 1)} FROM stays GROUP BY code
UNION ALL SELECT code, 'stats', 'los_p90', {_gated('los_days', 0.9, 1)} FROM stays GROUP BY code
UNION ALL SELECT code, 'stats', 'median_set', {_gated('amount_set', 0.5, 2)} FROM stays GROUP BY code
UNION ALL SELECT code, 'stats', 'median_posted', {_gated('amount_posted', 0.5, 2)} FROM stays GROUP BY code
UNION ALL SELECT code, 'stats', 'person_median_set', {_gated('amount', 0.5, 2)} FROM people GROUP BY code
UNION ALL SELECT code, 'stats', 'person_recorded_set_share',
          CASE WHEN a >= 5 AND p >= 5 THEN round_even(a / p, 3) END FROM per
UNION ALL SELECT code, 'stats', value, CASE WHEN c BETWEEN 1 AND 4 THEN NULL ELSE CAST(c AS DOUBLE) END FROM raw
UNION ALL SELECT code, dim, value, CASE WHEN c BETWEEN 1 AND 4 THEN NULL ELSE CAST(c AS DOUBLE) END
          FROM ranked WHERE dim <> 'top_citizenship' OR rn <= 5"""

# --- registry and listing ---------------------------------------------------

WORDS_W = "' W' || (p_partkey // 40)"
WORDS_WK = "' W' || (p_partkey // 40) || ' K' || (p_partkey // 9)"
MORE_WORDS = " || ".join(f"' U{i}x' || (p_partkey // 400)" for i in range(1, 10))
PART_WORDS = f"""(CASE WHEN p_partkey % 25 = 7 THEN ' hub' ELSE '' END
    || CASE WHEN p_partkey % 40 = 11 THEN {MORE_WORDS} ELSE '' END)"""
REGISTRY_NAME = f"p_name || {PART_WORDS} || {WORDS_WK} || ' ctr'"
LISTING_NAME = f"""
    CASE p_partkey % 8
         WHEN 0 THEN p_name || {PART_WORDS} || {WORDS_WK} || ' Center'
         WHEN 2 THEN 'The' || {WORDS_WK} || ' center'
         WHEN 3 THEN p_name || 's' || {PART_WORDS} || {WORDS_WK} || ' ctr'
         WHEN 4 THEN 'alias ' || p_partkey
         WHEN 5 THEN 'unknown place ' || p_partkey
         WHEN 6 THEN p_name || {PART_WORDS} || {WORDS_W} || ' ctr'
         ELSE p_name || {PART_WORDS} || {WORDS_WK} || ' ctr' END"""
LISTING_ZIP = "CAST(CASE WHEN p_partkey % 8 IN (0, 6, 7) THEN p_size ELSE p_size + 1000 END AS VARCHAR)"

LINK_PAIRS = f"""
reg_names AS (
    SELECT 'P' || p_partkey AS code, p_partkey AS r_order, upper(p_brand) AS state,
           lpad(CAST(p_size AS VARCHAR), 5, '0') AS zip5, {REGISTRY_NAME} AS name,
           {_tokens(REGISTRY_NAME)} AS words FROM part),
generic AS (
    SELECT token FROM (SELECT unnest(list_distinct(words)) AS token FROM reg_names)
    GROUP BY token HAVING count(*) > 0.05 * (SELECT count(*) FROM reg_names)),
gen AS (SELECT list(token) AS g FROM generic),
reg AS (
    SELECT r.*, array_to_string(words, ' ') AS norm,
           list_filter(list_distinct(words), lambda t: NOT list_contains(g, t)) AS toks
    FROM reg_names r, gen),
lst_names AS (
    SELECT p_partkey AS l_id, {LISTING_NAME} AS l_name,
           CASE WHEN p_partkey % 8 = 7 THEN 'NOWHERE' ELSE upper(p_brand) END AS state,
           lpad({LISTING_ZIP}, 5, '0') AS zip5 FROM part),
lst AS (
    SELECT *, array_to_string(words, ' ') AS norm,
           list_filter(list_distinct(words), lambda t: NOT list_contains(g, t)) AS toks
    FROM (SELECT *, {_tokens('l_name')} AS words FROM lst_names), gen),
overrides AS (
    SELECT 'ALIAS ' || p_partkey AS name_key, upper(p_brand) AS state,
           'P' || CASE WHEN p_partkey % 16 = 4 THEN p_partkey - 4 ELSE p_partkey END AS o_code
    FROM part WHERE p_partkey % 8 = 4),
at_zip AS (
    SELECT l_id, r.code, len(list_intersect(l.toks, r.toks)) AS shared, len(l.toks) AS width
    FROM lst l JOIN reg r ON l.state = r.state AND l.zip5 = r.zip5
    WHERE len(list_intersect(l.toks, r.toks)) > 0),
zip_ranked AS (
    SELECT *, count(*) OVER (PARTITION BY l_id) AS hits,
           rank() OVER (PARTITION BY l_id ORDER BY shared DESC) AS rk FROM at_zip),
zip_top AS (
    SELECT l_id, any_value(hits) AS hits, count(*) AS ties, min(code) AS z_code,
           any_value(shared) / any_value(width) AS z_score
    FROM zip_ranked WHERE rk = 1 GROUP BY l_id),
exact AS (
    SELECT l_id, arg_min(r.code, r.r_order) AS e_code
    FROM lst l JOIN reg r ON l.state = r.state AND l.norm = r.norm GROUP BY l_id),
inside AS (
    SELECT l_id, min(r.code) AS c_code
    FROM lst l JOIN reg r ON l.state = r.state
    WHERE len(l.toks) > 0 AND list_has_all(r.toks, l.toks)
    GROUP BY l_id HAVING count(*) = 1),
pairs AS (
    SELECT DISTINCT l.l_id, l.norm AS l_norm, r.code, r.r_order, r.norm AS r_norm
    FROM (SELECT l_id, state, norm, unnest(toks) AS tok FROM lst) l
    JOIN (SELECT code, r_order, state, norm, unnest(toks) AS tok FROM reg) r
      ON l.state = r.state AND l.tok = r.tok
    UNION ALL
    SELECT l.l_id, l.norm, r.code, r.r_order, r.norm FROM lst l JOIN reg r ON l.state = r.state WHERE len(l.toks) = 0)"""
SCORED = """
scored AS (
    SELECT l_id, code, r_order,
           (greatest(length(l_norm), length(r_norm)) - levenshtein(l_norm, r_norm))
           / greatest(length(l_norm), length(r_norm)) AS score FROM pairs)"""
# Ratcliff-Obershelp: the longest common block, earliest in the first name and then in the second, and
# the same again on both sides of it. A row of ``cut`` is two rests and the length of the block between.
SCORED_BLOCKS = """
compared AS (SELECT DISTINCT l_norm, r_norm FROM pairs),
cut(l_norm, r_norm, a, b, size) AS (
    SELECT l_norm, r_norm, l_norm, r_norm, 0 FROM compared
    UNION ALL
    SELECT l_norm, r_norm,
           CASE WHEN side = 0 THEN substring(a, 1, pos - 1) ELSE substring(a, pos + size) END,
           CASE WHEN side = 0 THEN substring(b, 1, b_pos - 1) ELSE substring(b, b_pos + size) END,
           CASE WHEN side = 0 THEN size ELSE 0 END
    FROM (SELECT l_norm, r_norm, a, b, best.size AS size, best.pos AS pos,
                 strpos(b, substring(a, best.pos, best.size)) AS b_pos
          FROM (SELECT *, list_filter(
                    list_transform(range(0, length(a) * least(length(a), length(b))), lambda x: {
                        'size': least(length(a), length(b)) - x // length(a), 'pos': x % length(a) + 1}),
                    lambda c: c.pos + c.size - 1 <= length(a) AND contains(b, substring(a, c.pos, c.size)))[1] AS best
                FROM cut WHERE a <> '' AND b <> '')
          WHERE best IS NOT NULL),
         (VALUES (0), (1)) AS sides(side)),
alike AS (
    SELECT l_norm, r_norm, CASE WHEN length(l_norm) + length(r_norm) = 0 THEN 1
                                ELSE 2 * sum(size) / (length(l_norm) + length(r_norm)) END AS score
    FROM cut GROUP BY l_norm, r_norm),
scored AS (SELECT l_id, code, r_order, score FROM pairs JOIN alike USING (l_norm, r_norm))"""
FUZZY = """
fuzzy AS (
    SELECT l_id, code AS f_code, score AS f_score
    FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_order) AS rn
          FROM scored WHERE score > 0) WHERE rn = 1)"""
LINK = f"{LINK_PAIRS},{SCORED},{FUZZY}"
LINK_BLOCKS = f"{LINK_PAIRS},{SCORED_BLOCKS},{FUZZY}"

JOINED = """
joined AS (
    SELECT l.l_id, l.l_name, l.state, o_code, z.hits, z.ties, z_code, z_score, e_code, c_code, f_code, f_score,
           l.state IN (SELECT state FROM reg) AS has_block
    FROM lst l
    LEFT JOIN overrides o ON upper(trim(l.l_name)) = o.name_key AND l.state = o.state
    LEFT JOIN zip_top z USING (l_id) LEFT JOIN exact USING (l_id)
    LEFT JOIN inside USING (l_id) LEFT JOIN fuzzy USING (l_id)),
staged AS (
    SELECT *, CASE
        WHEN o_code IS NOT NULL THEN 'override'
        WHEN NOT has_block THEN 'unmatched:no-candidates-in-state'
        WHEN hits = 1 THEN 'zip+token'
        WHEN ties = 1 THEN 'zip+token:multi'
        WHEN e_code IS NOT NULL THEN 'exact-name'
        WHEN c_code IS NOT NULL THEN 'distinctive-token'
        WHEN f_score >= 0.84 THEN 'fuzzy'
        WHEN ties > 1 THEN 'unmatched:ambiguous-at-zip'
        ELSE 'unmatched' END AS method
    FROM joined),
matches AS (
    SELECT l_id, l_name, state, method,
        CASE method WHEN 'override' THEN o_code WHEN 'zip+token' THEN z_code
             WHEN 'zip+token:multi' THEN z_code WHEN 'exact-name' THEN e_code
             WHEN 'distinctive-token' THEN c_code WHEN 'fuzzy' THEN f_code END AS code,
        CASE method WHEN 'zip+token:multi' THEN round_even(z_score, 3)
             WHEN 'distinctive-token' THEN 1.0 WHEN 'fuzzy' THEN round_even(f_score, 3)
             WHEN 'unmatched' THEN round_even(f_score, 3) END AS score
    FROM staged)"""
CROSSWALK = f"{LINK},{JOINED}"

NO_SCORE = "CAST(NULL AS DOUBLE) AS score"
ORACLES["q_link_override"] = f"""
WITH {LINK}
SELECT l_id, o_code AS code, 'override' AS method, {NO_SCORE}
FROM lst JOIN overrides o ON upper(trim(l_name)) = o.name_key AND lst.state = o.state"""
ORACLES["q_link_key_token"] = f"""
WITH {LINK} SELECT l_id, z_code AS code, 'zip+token' AS method, {NO_SCORE} FROM zip_top WHERE hits = 1"""
ORACLES["q_link_strict_winner"] = f"""
WITH {LINK} SELECT l_id, z_code AS code, 'zip+token:multi' AS method, round_even(z_score, 3) AS score
FROM zip_top WHERE hits > 1 AND ties = 1"""
ORACLES["q_link_exact"] = f"""
WITH {LINK} SELECT l_id, e_code AS code, 'exact-name' AS method, {NO_SCORE} FROM exact"""
ORACLES["q_link_containment"] = f"""
WITH {LINK} SELECT l_id, c_code AS code, 'distinctive-token' AS method, CAST(1.0 AS DOUBLE) AS score FROM inside"""
ORACLES["q_link_levenshtein"] = f"""
WITH {LINK} SELECT l_id, f_code AS code, 'fuzzy' AS method, round_even(f_score, 3) AS score
FROM fuzzy WHERE f_score >= 0.84"""
ORACLES["q_link_difflib"] = f"""
WITH RECURSIVE {LINK_BLOCKS} SELECT l_id, f_code AS code, 'fuzzy' AS method, round_even(f_score, 3) AS score
FROM fuzzy WHERE f_score >= 0.84"""
ORACLES["q_crosswalk"] = f"WITH {CROSSWALK} SELECT l_id, state, code, method, CAST(score AS DOUBLE) AS score FROM matches"
ORACLES["q_crosswalk_difflib"] = f"""
WITH RECURSIVE {LINK_BLOCKS},{JOINED} SELECT l_id, state, code, method, CAST(score AS DOUBLE) AS score FROM matches"""
ORACLES["q_match_report"] = f"""
WITH {CROSSWALK}
SELECT 'total' AS figure, CAST(count(*) AS DOUBLE) AS value FROM matches
UNION ALL SELECT 'matched', CAST(count(code) AS DOUBLE) FROM matches
UNION ALL SELECT 'rate', round(count(code) / count(*), 6) FROM matches
UNION ALL SELECT 'method:' || method, CAST(count(*) AS DOUBLE) FROM matches WHERE code IS NOT NULL GROUP BY method"""
ORACLES["q_unmatched"] = f"""
WITH {CROSSWALK} SELECT l_name AS name, state, CAST(score AS DOUBLE) AS best_score FROM matches WHERE code IS NULL"""
ORACLES["q_collisions"] = f"""
WITH {CROSSWALK}
SELECT * FROM (SELECT code, count(*) OVER (PARTITION BY code) AS claims, l_name, method
               FROM matches WHERE code IS NOT NULL) WHERE claims > 1"""
ORACLES["q_weak_matches"] = f"""
WITH {CROSSWALK}
SELECT m.l_id, m.l_name, r.name AS r_name, m.code, m.method
FROM matches m JOIN reg r USING (code) JOIN lst USING (l_id)
WHERE len(list_intersect(lst.toks, r.toks)) = 0"""
ORACLES["q_check_match_rate"] = f"""
WITH {CROSSWALK}
SELECT 'match_rate' AS rule, l_name AS key, 'unmatched in ' || state AS detail FROM matches
WHERE code IS NULL AND (SELECT count(code) / count(*) FROM matches) < 0.95"""

# --- text -------------------------------------------------------------------

ORACLES["q_normalize_names"] = f"""
WITH named AS (SELECT p_partkey AS l_id, {LISTING_NAME} AS name, {LISTING_ZIP} AS zip FROM part)
SELECT l_id, array_to_string({_tokens('name')}, ' ') AS norm,
       'SYNTH-' || left(trim(regexp_replace(upper(name), '[^A-Z0-9]+', '-', 'g'), '-'), 40) AS slug,
       lpad(left(regexp_replace(zip, '[^0-9]', '', 'g'), 5), 5, '0') AS zip5,
       CAST(len(list_intersect({_tokens('name')}, ['CENTER', 'RING'])) AS INTEGER) AS shared
FROM named"""
ORACLES["q_generic_tokens"] = f"""
WITH docs AS (SELECT list_distinct({_tokens("replace(text, 'ß', 'SS')")}) AS toks FROM documents)
SELECT token, count(*) AS df FROM (SELECT unnest(toks) AS token FROM docs)
GROUP BY token HAVING count(*) / (SELECT count(*) FROM docs) > 0.05"""
ORACLES["q_token_frequency"] = f"""
SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens(REGISTRY_NAME)})) AS token FROM part)
GROUP BY token"""
ORACLES["q_display"] = """
WITH p AS (SELECT *, (p_retailprice - 900) / 10 AS price, floor((p_retailprice - 900) / 10) AS whole FROM part)
SELECT p_partkey,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
       || '''S US Brand#' || split_part(p_brand, '#', 2) AS title,
       CASE p_type WHEN 'ECONOMY' THEN 'Economy line' WHEN 'PROMO' THEN 'Promotional line' ELSE p_type END AS label,
       CASE WHEN p_size = 7 THEN 'Not publicly reported' WHEN whole = 0 THEN '0'
            ELSE format('{:,}', CAST(whole AS BIGINT)) || '.0' END AS shown_web,
       CASE WHEN whole = 0 THEN '0' WHEN abs(whole) < 10 THEN CAST(whole AS BIGINT) || '.0'
            ELSE format('{:,}', CAST(whole AS BIGINT)) END AS shown_report
FROM p"""
ORACLES["q_rating_class"] = """
SELECT doc_id,
       CASE WHEN regexp_matches(text, '(?i)fail') THEN 'fail'
            WHEN regexp_matches(text, '(?i)pass|meets|acceptable|superior|good') THEN 'pass' ELSE 'none' END AS rating_class,
       CASE WHEN contains(text, 'Fail') THEN 'fail' WHEN contains(text, 'Pass') THEN 'pass' ELSE 'none' END AS rating_paint
FROM documents"""

# --- geocoding --------------------------------------------------------------

WORD = "p_name || ' w' || (p_partkey // 8)"
LAT, LON = "(p_partkey % 160 - 80 + 0.5)", "(p_partkey % 340 - 170 + 0.25)"
DESIGNATOR = "'(?i)(?:\\s* (?:" + "|".join(PLACE_DESIGNATORS) + "))+\\s*$'"


def _norm_place(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"


def _stem_step(prefix: str) -> str:
    n = len(prefix)
    return (
        f"list_concat(ks, flatten(list_transform(list_filter(ks, lambda k: starts_with(k, '{prefix}')), "
        f"lambda k: CASE WHEN k LIKE '% city' THEN [substr(k, {n + 1}), substr(k, {n + 1}, length(k) - {n + 5})] "
        f"ELSE [substr(k, {n + 1})] END)))"
    )


_keys = "first_keys"
_steps = []
for _i, _prefix in enumerate(PLACE_PREFIXES):
    _steps.append(f"keys_{_i} AS (SELECT row_id, {_stem_step(_prefix)} AS ks FROM {_keys})")
    _keys = f"keys_{_i}"

PLACES = f"""
place_lines AS (
    SELECT upper(p_brand) AS state, p_retailprice AS area, {LAT} AS lat, {LON} AS lon, p_partkey AS row_id,
           CASE p_partkey % 6 WHEN 0 THEN {WORD} || ' city' WHEN 1 THEN 'Town of ' || {WORD} || ' City village'
                WHEN 2 THEN {WORD} || '-Davidson metropolitan government (balance)'
                WHEN 3 THEN {WORD} || ' city and borough' WHEN 4 THEN {WORD} || ' City'
                ELSE {WORD} || ' CDP' END AS name FROM part),
based AS (
    SELECT *, regexp_replace(regexp_replace(name, '\\(.*?\\)', ' ', 'g'), {DESIGNATOR}, '') AS base FROM place_lines),
first_keys AS (
    SELECT row_id, list_filter([{_norm_place('base')},
        CASE WHEN contains(base, '-') THEN {_norm_place(f"regexp_replace(split_part(base, '-', 1), {DESIGNATOR}, '')")} END,
        CASE WHEN {_norm_place('base')} LIKE '% city'
             THEN left({_norm_place('base')}, length({_norm_place('base')}) - 5) END],
        lambda k: k IS NOT NULL) AS ks FROM based),
{", ".join(_steps)},
flat_keys AS (
    SELECT row_id, unnest(ks) AS place, generate_subscripts(ks, 1) AS spot FROM {_keys}),
place_keys AS (
    SELECT row_id, place, row_number() OVER (PARTITION BY row_id ORDER BY min(spot)) - 1 AS pos
    FROM flat_keys WHERE place <> '' GROUP BY row_id, place),
entries AS (SELECT * FROM place_keys JOIN place_lines USING (row_id)),
winners AS (
    SELECT *, row_number() OVER (PARTITION BY pos = 0, state, place ORDER BY area DESC, row_id) AS rn FROM entries),
gazetteer AS (
    SELECT state, place, lat AS latitude, lon AS longitude FROM winners w WHERE rn = 1 AND (pos = 0 OR NOT EXISTS (
        SELECT 1 FROM winners p WHERE p.pos = 0 AND p.state = w.state AND p.place = w.place)))"""

COUNTIES = f"""
counties AS (
    SELECT upper(p_brand) AS state, lower(p_type) AS county,
           arg_max({LAT}, p_partkey) AS latitude, arg_max({LON}, p_partkey) AS longitude
    FROM part GROUP BY ALL),
states AS (SELECT state, avg(latitude) AS s_lat, avg(longitude) AS s_lon FROM counties GROUP BY state)"""

_roles = "|".join(sorted(ROLE_WORDS, key=len, reverse=True))
ENTITIES = f"""
entities AS (
    SELECT p_partkey,
           CASE p_partkey % 6 WHEN 0 THEN 'ERO ' || {WORD} || ' Hold Room'
                WHEN 1 THEN 'Hold Room (' || {WORD} || ' ' || p_brand || ')'
                WHEN 2 THEN p_type || ' County Jail' WHEN 3 THEN 'no such place ' || p_partkey
                WHEN 4 THEN 'south/' || {WORD} || ' Office' ELSE {WORD} || ' Annex' END AS name,
           CASE WHEN p_partkey % 6 = 5 THEN 'XX' ELSE upper(p_brand) END AS state,
           CASE WHEN p_partkey % 5 = 0 THEN {LAT} END AS lat,
           CASE WHEN p_partkey % 5 = 0 THEN {LON} END AS lon FROM part),
fragments AS (
    SELECT p_partkey, state, unnest(parts) AS fragment, generate_subscripts(parts, 1) AS part_no FROM (
        SELECT p_partkey, state, list_append(regexp_extract_all(name, '\\((.*?)\\)', 1),
               regexp_replace(name, '\\(.*?\\)', ' ', 'g')) AS parts FROM entities)),
worded AS (
    SELECT p_partkey, state, part_no, list_filter(string_split_regex(
        regexp_replace({_norm_place('fragment')}, '\\b(?:{_roles})\\b', ' ', 'g'), '\\s+'), lambda w: w <> '') AS raw
    FROM fragments),
trimmed AS (
    SELECT p_partkey, part_no,
           CASE WHEN len(raw) > 1 AND raw[-1] = lower(state) THEN raw[:-2] ELSE raw END AS w FROM worded),
sized AS (SELECT *, unnest(generate_series(1, len(w))) AS size FROM trimmed),
started AS (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS start FROM sized),
runs AS (
    SELECT p_partkey, array_to_string(w[start:start + size - 1], ' ') AS place,
           row_number() OVER (PARTITION BY p_partkey ORDER BY part_no, size DESC, start) AS spot FROM started),
candidates AS (
    SELECT p_partkey, place, row_number() OVER (PARTITION BY p_partkey ORDER BY min(spot)) - 1 AS pos
    FROM runs GROUP BY p_partkey, place)"""


def _title(column: str) -> str:
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _note(precision: str) -> str:
    return f"replace({_quote(PRECISION_NOTES[precision])}, '{{place}}', matched)"


GEOCODED = f"""
{PLACES}, {COUNTIES}, {ENTITIES},
city_hits AS (
    SELECT p_partkey, arg_min(g.latitude, pos) AS c_lat, arg_min(g.longitude, pos) AS c_lon, arg_min(place, pos) AS c_place
    FROM candidates JOIN entities e USING (p_partkey) JOIN gazetteer g USING (state, place) GROUP BY p_partkey),
county_hits AS (
    SELECT p_partkey, arg_min(k.latitude, pos) AS k_lat, arg_min(k.longitude, pos) AS k_lon, arg_min(place, pos) AS k_place
    FROM candidates JOIN entities e USING (p_partkey) JOIN counties k ON k.state = e.state AND k.county = place
    WHERE regexp_matches(e.name, '(?i)\\bcounty\\b') GROUP BY p_partkey),
decided AS (
    SELECT e.*, c_lat, c_lon, k_lat, k_lon, s_lat, s_lon,
        CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'exact'
             WHEN p_partkey % 6 = 3 AND p_partkey % 4 = 1 THEN 'manual_county_seat'
             WHEN c_lat IS NOT NULL THEN 'city_centroid' WHEN k_lat IS NOT NULL THEN 'county_centroid'
             WHEN s_lat IS NOT NULL THEN 'state_centroid' ELSE 'none' END AS precision,
        CASE WHEN p_partkey % 6 = 3 AND p_partkey % 4 = 1 THEN 'Somewhere'
             WHEN c_lat IS NOT NULL THEN {_title('c_place')} || ', ' || e.state
             WHEN k_lat IS NOT NULL THEN {_title('k_place')} || ' County, ' || e.state
             WHEN s_lat IS NOT NULL THEN e.state END AS matched
    FROM entities e LEFT JOIN city_hits USING (p_partkey) LEFT JOIN county_hits USING (p_partkey)
    LEFT JOIN states s ON s.state = e.state),
geocoded AS (
    SELECT p_partkey, name, state,
        CASE precision WHEN 'exact' THEN lat WHEN 'manual_county_seat' THEN 10.5 WHEN 'city_centroid' THEN c_lat
             WHEN 'county_centroid' THEN k_lat WHEN 'state_centroid' THEN s_lat END AS latitude,
        CASE precision WHEN 'exact' THEN lon WHEN 'manual_county_seat' THEN 20.25 WHEN 'city_centroid' THEN c_lon
             WHEN 'county_centroid' THEN k_lon WHEN 'state_centroid' THEN s_lon END AS longitude,
        precision AS location_precision,
        CASE WHEN precision NOT IN ('exact', 'none') THEN matched END AS location_matched_to,
        CASE precision WHEN 'none' THEN {_quote(UNPLACED_NOTE)}
             WHEN 'manual_county_seat' THEN {_note('manual_county_seat')}
             WHEN 'city_centroid' THEN {_note('city_centroid')}
             WHEN 'county_centroid' THEN {_note('county_centroid')}
             WHEN 'state_centroid' THEN {_note('state_centroid')} END AS location_note,
        CASE WHEN precision = 'exact' THEN 0 ELSE 1 END AS approx,
        CASE precision WHEN 'manual_county_seat' THEN 'Hand-placed: by rule'
             WHEN 'city_centroid' THEN {_quote(PLACE_SOURCE)} WHEN 'county_centroid' THEN {_quote(COUNTY_SOURCE)}
             WHEN 'state_centroid' THEN {_quote(STATE_SOURCE)} END AS location_source,
        CASE WHEN lat IS NOT NULL AND lon IS NOT NULL
             THEN 'geo:' || CAST(lat AS DOUBLE) || ',' || CAST(lon AS DOUBLE)
                  || '?q=' || CAST(lat AS DOUBLE) || ',' || CAST(lon AS DOUBLE) END AS uri
    FROM decided)"""

ORACLES["q_place_keys"] = f"WITH {PLACES} SELECT row_id, CAST(pos AS INTEGER) AS pos, place FROM place_keys"
ORACLES["q_candidates"] = f"WITH {ENTITIES} SELECT p_partkey, CAST(pos AS INTEGER) AS pos, place FROM candidates"
ORACLES["q_gazetteer"] = f"""
WITH {PLACES} SELECT state, place, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude FROM gazetteer"""
ORACLES["q_county_points"] = f"""
WITH {COUNTIES} SELECT state, county, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude FROM counties"""
ORACLES["q_centroids"] = f"""
WITH {COUNTIES}
SELECT state, round(avg(latitude), 9) AS latitude, round(avg(longitude), 9) AS longitude,
       CAST(min(latitude) AS DOUBLE) AS lat_min, CAST(max(latitude) AS DOUBLE) AS lat_max,
       CAST(min(longitude) AS DOUBLE) AS lon_min, CAST(max(longitude) AS DOUBLE) AS lon_max
FROM counties GROUP BY state"""
ORACLES["q_geocode"] = f"""
WITH {GEOCODED}
SELECT p_partkey, round(CAST(latitude AS DOUBLE), 9) AS latitude, round(CAST(longitude AS DOUBLE), 9) AS longitude,
       location_precision, location_matched_to, location_note, approx, location_source, uri FROM geocoded"""
ORACLES["q_outside_bounds"] = """
WITH county AS (
    SELECT upper(n_name) AS state, n_nationkey * 3 - 30 + (c_custkey % 7) * 0.5 AS lat,
           n_nationkey * 5 - 60 + (c_custkey % 5) * 0.5 AS lon
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
boxes AS (SELECT state, min(lat) - 1.5 AS a, max(lat) + 1.5 AS b, min(lon) - 1.5 AS c, max(lon) + 1.5 AS d FROM county GROUP BY state),
sup AS (
    SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 'Atlantis' ELSE n_name END AS state,
           CAST(n_nationkey * 3 - 33 + s_suppkey % 13 AS DOUBLE) AS latitude, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS longitude
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, sup.state, latitude, longitude, CASE WHEN a IS NULL THEN 'unknown' ELSE 'outside' END AS placement
FROM sup LEFT JOIN boxes ON upper(sup.state) = boxes.state
WHERE a IS NULL OR NOT (latitude BETWEEN a AND b AND longitude BETWEEN c AND d)"""

# --- releases ---------------------------------------------------------------


def _release(name: str, condition: str) -> str:
    return f"""
    {name} AS (
        SELECT c_custkey AS code, any_value(c_name) AS name, any_value(c_mktsegment) AS state,
               CASE WHEN count(*) >= 3 THEN count(*) * 12.0::DOUBLE END AS adp,
               max(o_orderpriority) AS contract_type, max(o_orderstatus) AS last_rating
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderdate {condition} TIMESTAMP '1998-01-01' GROUP BY c_custkey)"""


def _people(value: str) -> str:
    return (
        f"CASE WHEN {value} = 0 THEN '0' WHEN {value} < 10 THEN printf('%.1f', {value}) "
        f"ELSE format('{{:,}}', CAST({value} AS BIGINT)) END"
    )


RELEASES = f"""
{_release('was', '<')}, {_release('now', '>=')},
both_sides AS (
    SELECT coalesce(was.code, now.code) AS code, was.code IS NULL AS only_now, now.code IS NULL AS only_was,
           coalesce(now.name, was.name) || ' (' || coalesce(now.state, was.state) || ')' AS label,
           was.adp AS old_value, now.adp AS new_value, abs(now.adp - was.adp) AS delta,
           was.contract_type AS old_contract, now.contract_type AS new_contract,
           was.last_rating AS old_rating, now.last_rating AS new_rating
    FROM was FULL OUTER JOIN now ON was.code = now.code),
changes AS (
    SELECT code, label, 'added' AS change_type, CAST(NULL AS VARCHAR) AS field, old_value, new_value,
           CASE WHEN new_value IS NULL THEN 'new facility, population not reported'
                ELSE 'new facility, ' || {_people('new_value')} || ' average daily population' END AS detail
    FROM both_sides WHERE only_now
    UNION ALL
    SELECT code, label, 'removed', NULL, old_value, new_value,
           CASE WHEN old_value IS NULL THEN 'no longer in the release, population was not reported'
                ELSE 'no longer in the release, last reported ' || {_people('old_value')} || ' held' END
    FROM both_sides WHERE only_was
    UNION ALL
    SELECT code, label, 'reporting_started', NULL, old_value, new_value,
           'population now reported as ' || {_people('new_value')}
    FROM both_sides WHERE NOT only_now AND NOT only_was AND old_value IS NULL AND new_value IS NOT NULL
    UNION ALL
    SELECT code, label, 'reporting_stopped', NULL, old_value, new_value,
           'population no longer reported, was ' || {_people('old_value')}
    FROM both_sides WHERE NOT only_now AND NOT only_was AND old_value IS NOT NULL AND new_value IS NULL
    UNION ALL
    SELECT code, label, 'swings', NULL, old_value, new_value,
           CASE WHEN new_value > old_value THEN 'up ' ELSE 'down ' END || {_people('delta')}
           || ' (' || CAST(round_even(delta / old_value * 100, 0) AS BIGINT) || '%), '
           || {_people('old_value')} || ' to ' || {_people('new_value')}
    FROM both_sides WHERE delta >= 25 AND delta / old_value >= 0.10
    UNION ALL
    SELECT code, label, 'attributes', 'contract_type', old_value, new_value,
           'contract type: ' || old_contract || ' → ' || new_contract
    FROM both_sides WHERE NOT only_now AND NOT only_was AND old_contract IS DISTINCT FROM new_contract
    UNION ALL
    SELECT code, label, 'attributes', 'last_rating', old_value, new_value,
           'inspection rating: ' || old_rating || ' → ' || new_rating
    FROM both_sides WHERE NOT only_now AND NOT only_was AND old_rating IS DISTINCT FROM new_rating)"""

ORACLES["q_release_diff"] = f"WITH {RELEASES} SELECT code, label, change_type, field, detail, old_value, new_value FROM changes"
ORACLES["q_release_attributes"] = f"""
WITH {RELEASES} SELECT field, detail, count(*) AS n FROM changes WHERE change_type = 'attributes' GROUP BY field, detail"""
ORACLES["q_release_counts"] = f"""
WITH {RELEASES}
SELECT 'before' AS figure, count(*) AS n FROM was UNION ALL SELECT 'after', count(*) FROM now
UNION ALL SELECT change_type, count(*) FROM changes GROUP BY change_type"""
ORACLES["q_key_sets"] = f"""
WITH {RELEASES}
SELECT code, CASE WHEN only_now THEN 'added' WHEN only_was THEN 'removed' ELSE 'kept' END AS membership FROM both_sides"""
ORACLES["q_release_stream"] = f"WITH {RELEASES} SELECT code, change_type, detail FROM changes"

# --- agreement --------------------------------------------------------------

POPULATION = """
population AS (
    SELECT l_partkey AS code, count(*) * 25.0::DOUBLE AS ours, max(l_quantity) * 8 AS peak,
           sum(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_discount > 0.03) AS part_a,
           sum(l_quantity) FILTER (WHERE l_returnflag = 'N' AND l_discount > 0.03) AS part_n,
           sum(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.03) AS part_r,
           max(l_quantity) FILTER (WHERE l_discount > 0.03) AS level_a
    FROM lineitem GROUP BY l_partkey),
pairs AS (SELECT *, part_a + part_n + part_r AS theirs FROM population)"""
POSITIVE = "positive AS (SELECT *, theirs / ours AS ratio FROM pairs WHERE theirs > 0 AND ours > 0)"

ORACLES["q_agreement"] = f"""
WITH {POPULATION}, {POSITIVE},
ordered AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS spot, count(*) OVER () AS n FROM positive)
SELECT (SELECT count(*) FROM positive) AS n, (SELECT round(corr(ours, theirs), 6) FROM positive) AS correlation,
       (SELECT round(ratio, 6) FROM ordered WHERE spot = n // 2) AS median_ratio"""
DURATIONS = f"""
{STAYS},
durations AS (
    SELECT code, avg(los_days) AS ours, avg(los_days) FILTER (criminality = 'O') AS theirs FROM stays GROUP BY code),
usable AS (SELECT *, theirs - ours AS difference FROM durations WHERE ours <> 0 AND theirs > 0)"""
ORACLES["q_within_share"] = f"""
WITH {DURATIONS}
SELECT count(*) AS n, round(corr(ours, theirs), 6) AS correlation,
       count(*) FILTER (WHERE abs(difference) <= 0.1 * greatest(ours, theirs)) AS within,
       round(count(*) FILTER (WHERE abs(difference) <= 0.1 * greatest(ours, theirs)) / count(*), 6) AS within_share
FROM usable"""
ORACLES["q_duration_extremes"] = f"""
WITH {DURATIONS},
ranked AS (SELECT code, difference, row_number() OVER (ORDER BY difference, code) AS up,
                  row_number() OVER (ORDER BY difference DESC, code DESC) AS down FROM usable)
SELECT 'low' AS "end", code, round(difference, 6) AS difference FROM ranked WHERE up <= 3
UNION ALL SELECT 'high', code, round(difference, 6) FROM ranked WHERE down <= 3"""
ORACLES["q_extremes"] = f"""
WITH {POPULATION}, {POSITIVE},
ranked AS (SELECT code, ratio, row_number() OVER (ORDER BY ratio, code) AS up,
                  row_number() OVER (ORDER BY ratio DESC, code DESC) AS down FROM positive)
SELECT 'low' AS "end", code, round(ratio, 9) AS ratio FROM ranked WHERE up <= 3
UNION ALL SELECT 'high', code, round(ratio, 9) FROM ranked WHERE down <= 3"""
ORACLES["q_stale"] = f"""
WITH {POPULATION}
SELECT code, theirs, peak, round(theirs / peak, 9) AS ratio,
       row_number() OVER (ORDER BY theirs / peak DESC, code DESC) AS place FROM pairs WHERE theirs > 0 AND peak > 0 AND theirs > peak"""
ORACLES["q_totals"] = """
WITH v AS (
    SELECT *, CASE WHEN l_quantity > 3 THEN l_discount END AS a, CASE WHEN l_discount > 0.02 THEN l_tax END AS b FROM lineitem),
w AS (SELECT *, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS loose, a + b AS strict FROM v)
SELECT l_returnflag, l_linestatus, count(*) AS "rows", count(loose) AS loose_known, count(strict) AS strict_known,
       CAST(sum(CAST(loose AS DECIMAL(18, 2))) AS DOUBLE) AS loose_sum, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day
FROM w GROUP BY l_returnflag, l_linestatus"""

# --- assembled records ------------------------------------------------------

RECORDS = f"""
{GEOCODED}, {POPULATION}, {_stays('l_partkey')},
profiled AS (SELECT code, count(*) AS stays FROM stays GROUP BY code),
records AS (
    SELECT g.p_partkey AS code, g.name, upper(g.state) AS state, g.location_precision AS precision,
           g.latitude, p.ours AS adp, p.peak,
           (p.code IS NOT NULL AND g.p_partkey % 4 <> 3) AS has_attributes,
           CASE WHEN p.code IS NOT NULL AND g.p_partkey % 4 <> 3 THEN ['Pass', 'Fail', 'Superior'][g.p_partkey % 3 + 1] END AS rating,
           CASE WHEN g.p_partkey % 4 <> 3 AND coalesce(part_a, part_n, part_r) IS NOT NULL
                THEN coalesce(part_a, 0) + coalesce(part_n, 0) + coalesce(part_r, 0) END AS total,
           CASE WHEN g.p_partkey % 4 <> 3 THEN level_a END AS level_a, stays
    FROM geocoded g LEFT JOIN population p ON p.code = g.p_partkey LEFT JOIN profiled f ON f.code = g.p_partkey)"""

ORACLES["q_assemble"] = f"""
WITH {RECORDS}
SELECT code, name, adp, rating, peak, total, coalesce(total <> 0 AND peak > 0 AND total > peak, FALSE) AS stale,
       level_a, has_attributes, stays, precision FROM records"""
ORACLES["q_placed_split"] = f"""
WITH {RECORDS}
SELECT latitude IS NOT NULL AS placed, CASE WHEN state = 'XX' THEN 'XX' ELSE replace(state, 'BRAND', 'Brand') END AS state,
       count(*) AS n FROM records GROUP BY ALL"""
ORACLES["q_build_report"] = f"""
WITH {RECORDS},
open_matches AS (SELECT p_partkey % 4 <> 3 AS hit FROM part)
SELECT 'counts' AS section, 'facilities_total' AS figure, CAST(count(*) AS DOUBLE) AS value FROM records
UNION ALL SELECT 'counts', 'mapped', CAST(count(latitude) AS DOUBLE) FROM records
UNION ALL SELECT 'counts', 'unplaced', CAST(count(*) - count(latitude) AS DOUBLE) FROM records
UNION ALL SELECT 'counts', 'exact_location', CAST(count(*) FILTER (WHERE precision = 'exact') AS DOUBLE) FROM records
UNION ALL SELECT 'counts', 'approximate_location', CAST(count(*) FILTER (WHERE precision NOT IN ('exact', 'none')) AS DOUBLE) FROM records
UNION ALL SELECT 'counts', 'with_ice_attributes', CAST(count(*) FILTER (WHERE latitude IS NOT NULL AND has_attributes) AS DOUBLE) FROM records
UNION ALL SELECT 'counts', 'with_demographics', CAST(count(*) FILTER (WHERE latitude IS NOT NULL AND stays IS NOT NULL) AS DOUBLE) FROM records
UNION ALL SELECT 'crosswalk', 'total', CAST(count(*) AS DOUBLE) FROM open_matches
UNION ALL SELECT 'crosswalk', 'matched', CAST(count(*) FILTER (WHERE hit) AS DOUBLE) FROM open_matches
UNION ALL SELECT 'crosswalk', 'rate', round_even(count(*) FILTER (WHERE hit) / count(*), 4) FROM open_matches
UNION ALL SELECT 'methods', 'key', CAST(count(*) AS DOUBLE) FROM open_matches WHERE hit
UNION ALL SELECT 'location_precision', precision, CAST(count(*) AS DOUBLE) FROM records GROUP BY precision"""
ORACLES["q_release_features"] = f"""
WITH {RECORDS}
SELECT code, name, CASE WHEN state = 'XX' THEN 'XX' ELSE replace(state, 'BRAND', 'Brand') END AS state,
       adp, rating AS last_rating, '2026-07-15' AS as_of FROM records WHERE latitude IS NOT NULL"""
ORACLES["q_provenance"] = """
SELECT 'orders' AS source, 'https://data.example/orders' AS url,
       strftime(max(o_orderdate), '%Y-%m-%d') AS as_of, count(*) AS "rows" FROM orders"""
ORACLES["q_orphans"] = """
SELECT DISTINCT o_custkey AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""

# --- gates ------------------------------------------------------------------

ORACLES["q_gate_suppression"] = f"""
WITH {STAYS}
SELECT 'small_cell' AS rule, code || '.age_bands.' || age_band AS key, CAST(count(*) AS VARCHAR) AS detail
FROM stays WHERE age_band IS NOT NULL GROUP BY code, age_band HAVING count(*) BETWEEN 1 AND 4"""
ORACLES["q_gate_profiles"] = f"""
WITH {_stays('l_partkey')},
per AS (SELECT code, count(amount_set) AS c, max(amount_set) - 50000 AS m FROM stays GROUP BY code)
SELECT 'small_cell' AS rule, CAST(code AS VARCHAR) AS key, 'release_reason.' || release_reason AS detail
FROM stays GROUP BY code, release_reason HAVING count(*) BETWEEN 3 AND 4
UNION ALL SELECT 'small_cell', CAST(code AS VARCHAR), 'n_set' FROM per WHERE c BETWEEN 3 AND 4
UNION ALL SELECT 'negative_median', CAST(code AS VARCHAR), 'median_set' FROM per WHERE m < 0
UNION ALL SELECT 'median_without_sample', CAST(code AS VARCHAR), 'median_set' FROM per WHERE m IS NOT NULL AND c < 5"""
ORACLES["q_gate_build"] = """
WITH r AS (
    SELECT CASE WHEN p_partkey % 50 = 1 THEN p_partkey - 1 ELSE p_partkey END AS code, p_partkey % 50 AS way, p_brand FROM part)
SELECT 'count_mismatch' AS rule, CAST(NULL AS VARCHAR) AS key,
       (SELECT count(*) FROM r) || ' of ' || (SELECT count(*) FROM supplier) AS detail
WHERE (SELECT count(*) FROM r) <> (SELECT count(*) FROM supplier)
UNION ALL SELECT 'duplicate_code', CAST(code AS VARCHAR), CAST(count(*) AS VARCHAR) FROM r GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'null_geometry', CAST(code AS VARCHAR), NULL FROM r WHERE way = 3
UNION ALL SELECT 'impossible_coordinates', CAST(code AS VARCHAR), NULL FROM r WHERE way = 2
UNION ALL SELECT 'uncited_company', CAST(code AS VARCHAR), NULL FROM r WHERE way = 4
UNION ALL SELECT 'unexplained_point', CAST(code AS VARCHAR), NULL FROM r WHERE way IN (26, 27)"""
ORACLES["q_fidelity"] = f"""
WITH {POPULATION}
SELECT 'fidelity.ice_fy_adp_total' AS rule, CAST(p_partkey AS VARCHAR) AS key
FROM part JOIN population ON code = p_partkey
WHERE p_partkey % 10 = 0 AND p_partkey % 4 <> 3 AND coalesce(part_a, part_n, part_r) IS NOT NULL"""
ORACLES["q_duplicates"] = "SELECT count(*) - count(DISTINCT p_name) AS duplicates FROM part"

# --- campaigns --------------------------------------------------------------

CAMPAIGNS = r"""
campaigns AS (
    SELECT doc_id AS row_id,
           'BF-' || CASE WHEN doc_id % 9 = 8 THEN '000007' WHEN doc_id < 100000 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') ELSE CAST(doc_id AS VARCHAR) END AS case_id,
           CASE WHEN doc_id % 9 > 2 THEN lang ELSE '' END AS region,
           CASE WHEN doc_id % 9 = 1 THEN NULL ELSE n_chars END AS goal, n_chars % 997 AS raised,
           ['immigration_only', 'not_reported', 'other', 'conviction_reported'][doc_id % 4 + 1] AS category,
           doc_id % 33 + 1 AS verified_day, doc_id % 28 + 1 AS expires_day,
           text AS public_summary, regexp_extract(text, '^[^.!?\n]*[.!?]?', 0) AS short_summary,
           coalesce(url, 'https://fund.example/cases/' || doc_id) AS contribution_url,
           CASE WHEN doc_id % 9 = 5 THEN '' ELSE source END AS recipient,
           doc_id % 9 = 6 AS bad_terms,
           ['accepting', 'funded', 'bond_posted', 'accepting', 'closed'][doc_id % 5 + 1] AS status,
           doc_id % 9 = 4 AS refused
    FROM documents LEFT JOIN pages ON page_id = doc_id)"""

BROKEN = r"""
broken AS (
    SELECT row_id, case_id, 'case_id' AS field, 'duplicate' AS rule
    FROM (SELECT *, min(row_id) OVER (PARTITION BY case_id) AS first_row FROM campaigns) WHERE row_id > first_row
    UNION ALL SELECT row_id, case_id, 'consent_confirmed', 'must be TRUE' FROM campaigns WHERE refused
    UNION ALL SELECT row_id, case_id, 'public_summary', 'contains an identifier' FROM campaigns
              WHERE regexp_matches(public_summary, '(?i)[\w.]+@[\w.]+')
    UNION ALL SELECT row_id, case_id, 'public_summary', 'too long' FROM campaigns WHERE length(public_summary) > 360
    UNION ALL SELECT row_id, case_id, 'bond_amount', 'must be a whole amount above zero' FROM campaigns WHERE goal IS NULL OR goal <= 0
    UNION ALL SELECT row_id, case_id, 'booking_category', 'unknown category' FROM campaigns WHERE category = 'other'
    UNION ALL SELECT row_id, case_id, 'status', 'unknown status' FROM campaigns WHERE status = 'closed'
    UNION ALL SELECT row_id, case_id, 'verified_on', 'must be YYYY-MM-DD' FROM campaigns WHERE verified_day > 31
    UNION ALL SELECT row_id, case_id, 'verified_on', 'in the future' FROM campaigns WHERE verified_day BETWEEN 16 AND 31
    UNION ALL SELECT row_id, case_id, 'contribution_url', 'must be a safe https address' FROM campaigns
              WHERE NOT regexp_matches(contribution_url, '^(?i:https)://[^/?#@]+([/?#]|$)')
    UNION ALL SELECT row_id, case_id, 'terms_url', 'must be a safe https address' FROM campaigns WHERE bad_terms
    UNION ALL SELECT row_id, case_id, 'contribution_recipient', 'required' FROM campaigns WHERE recipient = '')"""

ORACLES["q_contract_rows"] = f"WITH {CAMPAIGNS}, {BROKEN} SELECT row_id, case_id, field, rule FROM broken"
ORACLES["q_campaign_feed"] = f"""
WITH {CAMPAIGNS}, {BROKEN.replace("public_summary,", "short_summary,").replace("(public_summary)", "(short_summary)")},
good AS (SELECT * FROM campaigns WHERE row_id NOT IN (SELECT row_id FROM broken))
SELECT case_id, nullif(region, '') AS region, goal AS bond_amount, raised AS amount_raised,
       CASE category WHEN 'immigration_only' THEN 'Immigration-only classification' WHEN 'not_reported' THEN 'Not reported'
            ELSE 'Conviction reported' END AS label,
       '2026-07-' || lpad(CAST(verified_day AS VARCHAR), 2, '0') AS verified_on,
       CASE WHEN status = 'accepting' THEN contribution_url END AS contribution_url, status,
       greatest(0, goal - raised) AS remaining, CAST(least(100, round(raised / goal * 100)) AS INTEGER) AS percent,
       row_number() OVER (ORDER BY status <> 'accepting', case_id) AS place
FROM good"""
ORACLES["q_status"] = f"""
WITH {CAMPAIGNS}
SELECT CASE WHEN status = 'accepting' AND expires_day < 10 THEN 'verification_expired' ELSE status END AS status, count(*) AS n
FROM campaigns GROUP BY 1"""
ORACLES["q_feed_totals"] = f"""
WITH {CAMPAIGNS}
SELECT count(*) AS open_cases, CAST(coalesce(sum(goal), 0) AS BIGINT) AS total_goal,
       CAST(coalesce(sum(raised), 0) AS BIGINT) AS total_raised FROM campaigns WHERE status = 'accepting'"""

# --- serving ----------------------------------------------------------------

SERVED = """
served AS (
    SELECT c_custkey AS code, c_name AS name, n_name AS state, c_mktsegment AS contract,
           CASE WHEN c_acctbal > 0 THEN c_acctbal END AS adp,
           ['Pass', 'Fail', NULL, 'Meets standard'][c_custkey % 4 + 1] AS rating, CAST(c_custkey % 3 AS INTEGER) AS approx,
           CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 50)::DOUBLE * 0.7::DOUBLE - 20 END AS latitude,
           (c_custkey % 70)::DOUBLE * 0.9::DOUBLE - 30 AS longitude
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORACLES["q_search"] = f"""
WITH {SERVED}
SELECT code, name, state, rating FROM served
WHERE latitude IS NOT NULL AND contains(lower(name || ' ' || state || ' ' || contract), 'nation_1')
  AND contains(rating, 'Pass') AND approx = 0
UNION ALL
SELECT code, name, state, rating FROM served
WHERE latitude IS NOT NULL AND contract = 'BUILDING' AND rating IS NULL"""
ORACLES["q_facets"] = f"""
WITH {SERVED}
SELECT DISTINCT 'state' AS facet, state AS value FROM served
UNION ALL SELECT DISTINCT 'contract', contract FROM served
UNION ALL SELECT DISTINCT 'rating', rating FROM served WHERE rating IS NOT NULL"""
ORACLES["q_top_n"] = f"WITH {SERVED} SELECT code, adp FROM served ORDER BY coalesce(adp, 0) DESC, code LIMIT 300"
ORACLES["q_sorted_nulls_last"] = f"WITH {SERVED} SELECT code, rating, row_number() OVER (ORDER BY lower(rating) DESC NULLS LAST, code) AS place FROM served"
ORACLES["q_histogram"] = """
SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place
FROM orders GROUP BY o_orderpriority"""
ORACLES["q_distribution"] = f"""
WITH {SERVED}, long AS ({_long({'contract': 'contract', 'rating': 'rating'}, 'served', 'state')}),
counts AS (
    SELECT state, dim, value, CASE WHEN count(*) < 5 THEN 0 ELSE count(*) END AS shown FROM long GROUP BY state, dim, value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY state, dim ORDER BY shown DESC, value) AS rn FROM counts)
SELECT state, dim, value, shown, round(shown / greatest(sum(shown) OVER (PARTITION BY state, dim), 1), 6) AS share
FROM ranked WHERE rn <= 3"""
ORACLES["q_grid_rollup"] = f"""
WITH {SERVED}
SELECT CAST(floor(latitude / 5) AS BIGINT) AS cell_lat, CAST(floor(longitude / 5) AS BIGINT) AS cell_lon, count(*) AS points,
       CAST(sum(CAST(coalesce(adp, 0) AS DECIMAL(28, 6))) AS DOUBLE) AS adp_sum,
       count(*) FILTER (WHERE contains(rating, 'Fail')) AS fail_count
FROM served WHERE latitude IS NOT NULL GROUP BY 1, 2"""
ORACLES["q_distance"] = f"""
WITH {SERVED}, placed AS (SELECT * FROM served WHERE latitude IS NOT NULL),
centre AS (SELECT state, avg(latitude) AS lat0, avg(longitude) AS lon0 FROM placed GROUP BY state)
SELECT code, round(2 * 3958.8 * asin(sqrt(pow(sin(radians(latitude - lat0) / 2), 2)
       + pow(sin(radians(longitude - lon0) / 2), 2) * cos(radians(lat0)) * cos(radians(latitude)))), 3) AS miles
FROM placed JOIN centre USING (state)"""
ORACLES["q_ratio"] = """
SELECT o_custkey, CASE WHEN f >= 5 AND n >= 5 THEN round_even(f / n, 3) END AS share
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey)"""

# --- ranking ----------------------------------------------------------------

ORACLES["q_strict_winner"] = """
WITH per AS (SELECT o_custkey, o_orderpriority, count(*) AS score FROM orders GROUP BY 1, 2),
top AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY score DESC) AS rk FROM per)
SELECT o_custkey, any_value(o_orderpriority) AS o_orderpriority, any_value(score) AS score
FROM top WHERE rk = 1 GROUP BY o_custkey HAVING count(*) = 1"""
ORACLES["q_first_in_order"] = """
SELECT o_custkey, o_orderkey, o_orderstatus
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1"""
ORACLES["q_union_prefer"] = """
SELECT c_custkey AS code, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""

# --- usage ------------------------------------------------------------------


def _sessions(minutes: int) -> str:
    return f"""
    steps AS (
        SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    tagged AS (
        SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM steps),
    sessions AS (
        SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS events,
               epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM tagged GROUP BY user_id, session_no)"""


CONSENTED = """
consented AS (
    SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
    WHERE rn = 1 AND event_type <> 'error')"""

ORACLES["q_sessions"] = f"WITH {_sessions(30)} SELECT * FROM sessions"
ORACLES["q_sessions_6h"] = f"WITH {_sessions(360)} SELECT * FROM sessions"
ORACLES["q_sessions_stream"] = f"WITH {_sessions(30)} SELECT user_id, events, start_us, end_us FROM sessions"
ORACLES["q_sessionize"] = f"WITH {_sessions(360)} SELECT event_id, user_id, CAST(session_no AS BIGINT) AS session_no FROM tagged"
ORACLES["q_engagement"] = f"""
WITH {_sessions(360)}, pings AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS ms FROM tagged)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) FILTER (ms >= 1000) AS pings,
       CAST(coalesce(sum(ms) FILTER (ms >= 1000), 0) AS BIGINT) AS engaged_ms,
       coalesce(bool_or(ms >= 10000) FILTER (ms >= 1000), false) AS engaged FROM pings GROUP BY user_id, session_no"""
ORACLES["q_usage"] = """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS unique_clients FROM events GROUP BY event_type"""
ORACLES["q_consented"] = f"""
WITH {CONSENTED}
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS unique_clients
FROM events WHERE user_id IN (SELECT user_id FROM consented) GROUP BY event_type"""
ORACLES["q_usage_stream"] = f"""
WITH {CONSENTED}
SELECT epoch_us(date_trunc('day', ts)) AS window_start_us, event_type, count(*) AS events
FROM events WHERE user_id IN (SELECT user_id FROM consented) GROUP BY 1, 2"""

# --- sources ----------------------------------------------------------------


def _fingerprint(name: str, columns: dict[str, str]) -> str:
    texts = ", ".join(f"coalesce('v' || {columns[c]}, 'n')" for c in sorted(columns))
    return f"""
    SELECT '{name}' AS source, count(*) AS "rows",
           CAST(sum(CAST(('0x' || left(md5(concat_ws(chr(31), {texts})), 15)) AS BIGINT)) AS VARCHAR) AS fingerprint
    FROM {name}"""


def _texts(*columns: str) -> dict[str, str]:
    return {c: f"CAST({c} AS VARCHAR)" for c in columns}


ORACLES["q_fingerprint"] = " UNION ALL ".join([
    _fingerprint("region", _texts("r_regionkey", "r_name")),
    _fingerprint("nation", _texts("n_nationkey", "n_name", "n_regionkey")),
    _fingerprint("customer", _texts("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    _fingerprint("orders", _texts(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
])
ORACLES["q_changed_sources"] = " UNION ALL ".join(
    f"SELECT '{name}' AS source, '{state}' AS state, '{reasons}' AS reasons, "
    + (f"(SELECT count(*) FROM {name})" if before else "CAST(NULL AS BIGINT)") + " AS rows_before, "
    + (f"(SELECT count(*) FROM {name})" if after else "CAST(NULL AS BIGINT)") + " AS rows_after"
    for name, state, reasons, before, after in (
        ("region", "removed", "", True, False), ("nation", "unchanged", "", True, True),
        ("supplier", "changed", "content", True, True), ("customer", "changed", "url", True, True),
        ("part", "changed", "published", True, True), ("orders", "added", "", False, True),
        ("input:as_of", "changed", "content", False, False), ("input:method", "unchanged", "", False, False),
    )
)
ORACLES["q_located_header"] = "SELECT p_partkey, p_name, p_brand, p_size FROM part"
ORACLES["q_newest_release"] = """
SELECT 'FY_detail' || strftime(max(o_orderdate), '%m%d%Y') || '.xlsx' AS file_name,
       strftime(max(o_orderdate), '%Y-%m-%d') AS release_date FROM orders WHERE o_orderkey % 7 <> 0"""

# --- loaders, sinks and gates as they lie on disk ---------------------------

ORACLES["q_engagement_stream"] = ORACLES["q_engagement"]
ORACLES["q_diff_sink"] = ORACLES["q_release_stream"]
ORACLES["q_feed_sink"] = f"SELECT * EXCLUDE (place) FROM ({ORACLES['q_campaign_feed']})"
ORACLES["q_profile_sink"] = ORACLES["q_profile_bands"]
ORACLES["q_event_scan"] = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"""
ORACLES["q_registry_scan"] = """
SELECT CASE WHEN p_partkey % 10 > 0 THEN CAST(p_partkey AS VARCHAR)
            ELSE 'SYNTH-' || left(trim(regexp_replace(upper(name), '[^A-Z0-9]+', '-', 'g'), '-'), 40) END AS code,
       name, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS adp
FROM (SELECT *, p_name || ' no. ' || p_partkey AS name FROM part)"""
ORACLES["q_key_overrides"] = """
SELECT upper(p_name || ' ' || p_partkey) AS name_key, upper(p_brand) AS state, 'P' || p_partkey AS code
FROM part WHERE p_partkey % 5 > 0"""
ORACLES["q_gate_collisions"] = f"""
WITH {CROSSWALK}
SELECT 'collision' AS rule, code AS key, l_name || ' by ' || method AS detail
FROM (SELECT *, count(*) OVER (PARTITION BY code) AS claims FROM matches WHERE code IS NOT NULL) WHERE claims > 1"""
ORACLES["q_fidelity_profiles"] = f"""
WITH {STAYS}
SELECT DISTINCT CASE WHEN code % 10 = 0 THEN 'fidelity.profile_presence' ELSE 'fidelity.profile_value' END AS rule,
       CAST(code AS VARCHAR) AS key
FROM stays JOIN supplier ON s_suppkey = code WHERE code % 10 IN (0, 1) AND code % 7 > 0"""
