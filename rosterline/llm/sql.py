"""DuckDB counterparts of the newer queries that recursive SQL can express."""


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII string: bytes and, after each, eight shifts (-1) in one list."""
    steps, text = ", ".join(["-1"] * 8), f"({text})"
    flat = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [ascii({text}[i])::BIGINT, {steps}]))"
    shift = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return (
        f"xor(list_reduce({flat}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE {shift} END, "
        "4294967295::BIGINT), 4294967295::BIGINT)"
    )


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(before: str, cost: str, letter: str, line: str = "") -> str:
    """One more edit after the cheapest way ``before``."""
    return f"{{'c': {before}.c + {cost}, 'a': {before}.a || '{letter}', 'r': {before}.r{line}}}"


def _insert(before: str, role: str) -> str:
    return _way(before, "3", "I", f" || chr(10) || '{role}:'")


def _drop(before: str) -> str:
    return _way(before, "4", "D")


def _keep(before: str, initial: str) -> str:
    cost = f"(CASE WHEN ini = '{initial}' AND NOT gone THEN extra ELSE 1000000 END)"
    return _way(before, cost, "K", " || chr(10) || role || ':' || text")


def _rerole(before: str, role: str) -> str:
    return _way(before, "(CASE WHEN gone THEN 1000000 ELSE 3 + extra END)", "R", f" || chr(10) || '{role}:' || text")


_NONE = "{'c': 1000000::BIGINT, 'a': '', 'r': ''}"

TURN_REPAIR = rf"""
    WITH RECURSIVE d AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("key")} % 20 AS kind
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
    h AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM d),
    o AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                   sha256(strlen(role)::VARCHAR || ':' || role || text)) AS i
        FROM h),
    q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM o),
    f AS (
        SELECT *, role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'copy'
                    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'fine' ELSE 'cut' END AS fault
        FROM q),
    x AS (SELECT *, fault IN ('blank', 'copy') AS gone, CASE WHEN fault = 'cut' THEN 3 ELSE 0 END AS extra FROM f),
    w(conv_id, i, b, s, u, a) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'r': ''}}, {_NONE}, {_NONE}, {_NONE} FROM conversations
        UNION ALL
        SELECT conv_id, i, {_drop("b")}, {_least(_drop("s"), _keep("b", "s"))},
               {_least(_drop("u"), *(_keep(v, "u") for v in "bsa"), *(_rerole(v, "user") for v in "bsa"))},
               {_least(_drop("a"), _keep("u", "a"), _rerole("u", "assistant"))}
        FROM (SELECT conv_id, i, role, text, ini, gone, extra, b, s, u, {_least("a", _insert("u", "assistant"))} AS a
              FROM (SELECT w.conv_id, x.i, x.role, x.text, x.ini, x.gone, x.extra, w.b, w.s, w.a,
                           {_least("w.u", *(_insert("w." + v, "user") for v in "bsa"))} AS u
                    FROM w JOIN x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = w.i + 1))),
    e AS (
        SELECT conv_id, {_least("b", "a", _insert("u", "assistant"))} AS way,
               s, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back
        FROM w),
    g AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'copy') AS duplicate,
               count(*) FILTER (fault = 'cut') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM f GROUP BY conv_id),
    z AS (SELECT conv_id, {_least("way", "{'c': s.c + 6, 'a': s.a || 'II', 'r': s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}")} AS way
          FROM e WHERE back = 1)
    SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, way.c::BIGINT AS cost, way.a AS audit,
           sha256(substring(way.r, 2)) AS repaired_sha256
    FROM z LEFT JOIN g ON z.conv_id IS NOT DISTINCT FROM g.conv_id"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', chars, 'text']))})"


def _tree(source: str, name: str, key: str) -> str:
    """Nodes ({key}, level, idx, n, h) of the trees over ``source`` ({key}, idx, n, h)."""
    return f"""{name}({key}, level, idx, n, h) AS (
        SELECT {key}, 0, idx, n, h FROM {source}
        UNION ALL
        SELECT {key}, level + 1, idx // 2, (n + 1) // 2, sha256(h || coalesce(after, ''))
        FROM (SELECT *, lead(h) OVER (PARTITION BY {key} ORDER BY idx) AS after FROM {name} WHERE n > 1)
        WHERE idx % 2 = 0)"""


MERKLE_MANIFEST = f"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce('g' || lang, 'a') AS grp, {_leaf("n_chars")} AS h,
               {_leaf("(CASE WHEN " + _crc32("doc_id::VARCHAR") + " % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS later
        FROM documents),
    p AS (
        SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
               count(*) OVER (PARTITION BY grp) AS n
        FROM d),
    {_tree("p", "t", "grp")},
    subroots AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, 0 AS one
                 FROM t WHERE n = 1),
    {_tree("subroots", "top", "one")},
    every AS (
        SELECT grp, level, idx, n, h FROM t WHERE n > 1
        UNION ALL SELECT NULL, level, idx, n, h FROM top WHERE n > 1),
    climb(row, grp, level, idx, n, h, proof) AS (
        SELECT row, grp, 0, idx, n, later, '' FROM p
        UNION ALL
        SELECT c.row, CASE WHEN c.n > 1 THEN c.grp END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
               CASE WHEN c.n > 1 THEN c.idx // 2 ELSE r.idx END, CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE r.n END,
               CASE WHEN c.n > 1 THEN sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END)
                    ELSE c.h END,
               c.proof || coalesce(s.h, '')
        FROM climb c
        LEFT JOIN every s ON s.grp IS NOT DISTINCT FROM c.grp AND s.level = c.level AND s.idx = xor(c.idx, 1)
        LEFT JOIN subroots r ON r.grp = c.grp
        WHERE c.n > 1 OR c.grp IS NOT NULL)
    SELECT p.doc_id, p.h AS leaf, subroots.h AS subroot, root.h AS root, sha256(c.proof) AS proof_sha256,
           c.h AS folded_root, c.h = root.h AS verified
    FROM p JOIN subroots USING (grp) JOIN climb c ON c.row = p.row AND c.grp IS NULL AND c.n = 1
    CROSS JOIN (SELECT h FROM top WHERE n = 1) AS root"""

ORACLES = {"op12_turn_repair": TURN_REPAIR, "op13_merkle_manifest": MERKLE_MANIFEST}
