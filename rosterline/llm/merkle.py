"""Merkle manifest of a dataset: one tree per group, a tree over the subroots, and audit paths.

Leaves and nodes are lower-case hexadecimal SHA-256 digests; a node is the digest of its children's
digests, written one after the other, and a run of one child has a parent too. Levels are built
``STRIDE`` at a time, by grouping blocks of consecutive nodes, and written to the shared folder. Node rows
are linked to their ancestor that many levels up and hold the siblings in between. A recursive query
climbs from every leaf at once: each round joins the current nodes with their rows, appends the siblings
and folds the digest.

Scale: only digests and ids move, never texts. Positions within a group come from a range sort whose
partitions are counted, so a hot group is spread; a node that very many leaves climb through is one row
of the unique side of a join, whose other side adaptive execution splits. Only rows of inner nodes, one
for 2**STRIDE - 1 leaves, are joined in a round. A climb writes one row per leaf and round; rounds grow with
the logarithm of the largest group.

Nulls: a null value enters its leaf as ``-``; leaves with a null id come first, a null group is a group
of its own and the first one. Rows of one id are ordered by their leaf; equal rows are interchangeable. An
empty table gives an empty result. A row with a null id is never tampered with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, store

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
TOP = "top"
#: Levels that one node row spans.
STRIDE = 8
PATH = "array<struct<sibling:binary,is_left:boolean>>"


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def spelled(value: Column) -> Column:
    """Lower-case hexadecimal form of a digest."""
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """A value as it enters its leaf: byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``idx``, the place from 0 within the group, and ``n``, the size of the group.

    Rows are sorted by ranges and numbered inside their partition; only the counts of (group,
    partition) meet in a window, which are few however large a group is.
    """
    kept = store(df.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    keys = [*group, *order, "_row"]
    ranged = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    placed = store(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
        "merkle-sorted",
    )
    drop_stored(df.sparkSession, _folder(kept))
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole),
    }).drop("_n")
    parts = parts.withColumnsRenamed({c: f"_of_{c}" for c in [*group, "_part"]})
    same = F.col("_part") == F.col("_of__part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return placed.join(parts, same).select(
        *df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"), "n"
    )


def _parent_digests(level: Column) -> Column:
    """Digests of the pairs of a level, the last one perhaps of a single node."""
    def pair(i: Column) -> Column:
        right = F.coalesce(spelled(F.get(level, 2 * i + 1)), F.lit(""))
        return digest(F.concat(spelled(F.get(level, 2 * i)), right))

    return F.transform(F.sequence(F.lit(0), ((F.size(level) + 1) / 2).cast("int") - 1), pair)


def _path(levels: Column, place: Column, steps: Column) -> Column:
    """Sibling (null in a run of one) and side of the node at ``place`` on every level of its block."""
    def step(i: Column) -> Column:
        at = F.call_function("shiftright", place, i)
        sibling = F.get(F.get(levels, i), at.bitwiseXOR(F.lit(1)))
        return F.struct(sibling.alias("sibling"), (at % 2 == 0).alias("is_left"))

    return F.transform(F.sequence(F.lit(0), steps - 1), step)


def build_levels(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First steps, links and roots of the trees over ``leaves`` (tree, idx, n, node, digest, more).

    ``STRIDE`` levels are built at a time, from blocks of at most 2**STRIDE consecutive nodes. Node rows
    (node, parent, path) are linked to their ancestor that many levels up; the path has the siblings in
    between. First steps are the node rows of the leaves, with the column ``more``, a struct that is only
    handed on; links are those of all inner nodes. Roots: (tree, node, digest).
    """
    kind = leaves.schema["more"].dataType
    level, rounds, lone = leaves, [], [leaves.filter("n = 1").select("tree", "node", "digest", "more")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        steps = F.least(F.length(F.bin(F.col("n") - 1)), F.lit(STRIDE)).cast("int")
        items = F.struct("idx", "node", "digest", "more")
        blocks = level.filter("n > 1").groupBy("tree", "n", F.shiftright("idx", STRIDE).alias("up")).agg(
            F.array_sort(F.collect_list(items), lambda a, b: F.signum(a["idx"] - b["idx"]).cast("int")).alias("items")
        )
        grown = F.aggregate(
            F.sequence(F.lit(1), F.col("steps")), F.array(F.col("items.digest")),
            lambda done, _: F.concat(done, F.array(_parent_digests(F.element_at(done, -1)))),
        )
        here = F.concat_ws("/", "tree", F.lit(str(len(rounds) + 1)), F.col("up").cast("string"))
        blocks = store(
            blocks.withColumn("steps", steps).withColumn("levels", grown).withColumn("parent", here),
            f"merkle-{name}",
        )
        rounds.append(blocks)
        level = blocks.select(
            "tree", F.col("up").alias("idx"), F.expr("(n - 1 >> steps) + 1").alias("n"), F.col("parent").alias("node"),
            F.element_at(F.element_at("levels", -1), 1).alias("digest"), F.lit(None).cast(kind).alias("more"),
        )
        lone.append(level.filter("n = 1").select("tree", "node", "digest", "more"))
        most = (most - 1 >> STRIDE) + 1

    def node_rows(blocks: DataFrame) -> DataFrame:
        each = blocks.select("parent", "levels", "steps", F.posexplode("items").alias("place", "item"))
        return each.select("item.node", "parent", _path(F.col("levels"), F.col("place"), F.col("steps")).alias("path"), "item.more")

    none = leaves.sparkSession.createDataFrame([], f"node string, parent string, path {PATH}, more {kind.simpleString()}")
    first = lone[0].select("node", F.col("node").alias("parent"), F.array().cast(PATH).alias("path"), "more")
    first = first.unionByName(node_rows(rounds[0])) if rounds else first
    links = reduce(DataFrame.unionByName, [none, *map(node_rows, rounds[1:])]).drop("more")
    return first, links, reduce(DataFrame.unionByName, lone).select("tree", "node", "digest")


FOLD = """aggregate({path}, {start}, (done, s) -> unhex(sha2(concat(
    CASE WHEN s.is_left OR s.sibling IS NULL THEN '' ELSE lower(hex(s.sibling)) END, lower(hex(done)),
    CASE WHEN s.is_left AND s.sibling IS NOT NULL THEN lower(hex(s.sibling)) ELSE '' END), 256)))"""
CLIMB = f"""
    WITH RECURSIVE climb (leaf, at, depth, folded, path, more) AS (
        SELECT node, parent, 0, {FOLD.format(path="path", start="more.later")}, path, more FROM merkle_leaves
        UNION ALL
        SELECT c.leaf, l.parent, c.depth + 1, {FOLD.format(path="l.path", start="c.folded")}, l.path,
               CASE WHEN FALSE THEN c.more END
        FROM climb c JOIN merkle_links l ON c.at = l.node)
    SELECT leaf, depth, folded, path, more FROM climb"""


def climb(spark: SparkSession, first: DataFrame, links: DataFrame) -> DataFrame:
    """(leaf, depth, folded, path, more): the way of every leaf to its root.

    ``first`` has the first steps (node, parent, path, more) with the digest to fold in ``more.later``. The
    limit of rows of a recursive query is lifted in a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    for name, table in (("merkle_leaves", first), ("merkle_links", links)):
        kept = store(table, name.replace("_", "-"))
        own.read.schema(kept.schema).parquet(*_folder(kept)).createTempView(name)
    done = store(own.sql(CLIMB), "merkle-climb")
    return spark.read.schema(done.schema).parquet(*_folder(done))


def _folder(kept: DataFrame) -> list[str]:
    """Folder of a stored table."""
    return sorted({path.rsplit("/", 1)[0] for path in kept.inputFiles()})


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: list[str] | None = None, *,
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` maps column names to the values that a later reader sees instead; their leaf is folded
    along the original siblings.
    """
    spark, columns, tampered = docs.sparkSession, columns or COLUMNS, tampered or {}
    leaf = digest(F.concat(*[field(F.col(c)) for c in columns]))
    later = digest(F.concat(*[field(tampered.get(c, F.col(c))) for c in columns]))
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("leaf"), later.alias("later")
    )
    placed = store(numbered(slim, ["grp"], ["id", "leaf"]), "merkle-placed")
    groups = numbered(placed.select("grp").distinct(), [], ["grp"]).select(
        F.col("grp").alias("of_grp"), F.col("idx").cast("string").alias("tree")
    )
    groups = store(groups, "merkle-groups")
    leaves = placed.join(groups, F.col("grp").eqNullSafe(F.col("of_grp"))).select(
        "tree", "idx", "n", F.concat_ws("/", "tree", F.lit("0"), F.col("idx").cast("string")).alias("node"),
        F.col("leaf").alias("digest"), F.struct("id", "leaf", "later", "tree").alias("more"),
    )
    first, links, roots = build_levels(leaves, "groups")
    roots = store(roots, "merkle-subroots")
    tops = roots.select(
        F.lit(TOP).alias("tree"), F.col("tree").cast("long").alias("idx"), F.lit(roots.count()).cast("long").alias("n"),
        "node", "digest", F.lit(None).cast("struct<later:binary>").alias("more"),
    )
    top_first, top_links, top_root = build_levels(tops, TOP)
    top_first = top_first.filter("node <> parent").drop("more")
    way = climb(spark, first, links.unionByName(top_first).unionByName(top_links))
    root = top_root.select(spelled(F.col("digest"))).first()
    root = F.lit(root[0] if root else None).cast("string")
    climbed = way.groupBy("leaf").agg(
        F.max_by("folded", "depth").alias("folded"), F.max("more").alias("more"),
        F.array_sort(F.collect_list(F.struct("depth", "path"))).alias("way"),
    )
    subroots = roots.select("tree", F.col("digest").alias("subroot"))
    siblings = F.transform(F.flatten("way.path"), lambda s: spelled(s["sibling"]))
    return (
        climbed.select("folded", "way", "more.id", "more.leaf", "more.tree").join(subroots, "tree")
        .select(
            F.col("id").alias(id_col), spelled(F.col("leaf")).alias("leaf"), spelled(F.col("subroot")).alias("subroot"),
            root.alias("root"), F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
            spelled(F.col("folded")).alias("folded_root"), (spelled(F.col("folded")) == root).alias("verified"),
        )
    )


def one_more_char(id_col: str = "doc_id", chars_col: str = "n_chars", every: int = 7) -> dict[str, Column]:
    """Tampering that adds 1 to a count where ``every`` divides the CRC-32 of the decimal id."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return {chars_col: F.when(hit, F.col(chars_col) + 1).otherwise(F.col(chars_col))}
