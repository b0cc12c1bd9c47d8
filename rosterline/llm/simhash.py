"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are the nodes' bits from the root down. The join walks pairs of trie nodes together:
a pair descends to the pairs of its children, adds one to its differing bits where the two sides
part, and is dropped as soon as that exceeds the error budget. Pairs of small nodes are compared
directly.

Equal fingerprints are one class. Two fingerprints that differ in ``budget`` bits or fewer agree in
at least one of ``budget + 1`` bit blocks, so the distinct fingerprints are entered once per block,
rotated to begin with it, and only nodes that agree in the whole first block start a walk. These
starting nodes are independent tasks. A node with more than ``NODE_ROWS`` fingerprints is opened
further, eight bits at a time, into pairs of its descendants (again dropping pairs beyond the
budget) until each side is small: a hot block is many tasks, and distinct fingerprints run out of
bits to share, so opening ends. A task returns a spanning forest of its links, never all pairs.

Nulls: a null text is empty; an empty text has fingerprint zero. Ties and repeated rows fall into
one class. A row with a null id gets a component, but names it only if no other row can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store, text_of
from .components import components

SEED, BUDGET, SHINGLE = 42, 3, 3
NODE_ROWS = 512
#: Pairs of nodes with at most so many member pairs are compared at once.
LEAF_PAIRS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles of a lower-cased (A-Z) UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: ASCII letters and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[: 1 - shingle].tolist()
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], seed)
         for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)),
        dtype=">u8", count=len(starts),
    )
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype="u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps.view("i8"))], ["doc_id", "fp"]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, fp long")


def _weigh(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Union-find over the members of one partition."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = p
                return p
            p = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[i] with b[i]; whole arrays, repeated until the ends of every link agree."""
        while len(a):
            roots = self.roots()
            ra, rb = roots[a], roots[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def walk(keys: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    """Walk node pairs over ``keys``; rows of ``pairs``: low and high end of both sides.

    Each side is a run of sorted distinct keys; a pair of a run with itself joins it with itself.
    Links found are entered into ``forest`` by position in ``keys``.
    """
    alo, ahi, blo, bhi = pairs.T.copy()
    diff = np.zeros(len(alo), dtype=np.int64)
    for level in range(65):
        sizes = (ahi - alo) * (bhi - blo)
        leaf = (sizes <= LEAF_PAIRS) if level < 64 else np.ones(len(sizes), dtype=bool)
        if leaf.any():
            n, width = sizes[leaf], (bhi - blo)[leaf]
            pair = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = alo[leaf][pair] + k // width[pair]
            b = blo[leaf][pair] + k % width[pair]
            near = (a != b) & (_weigh(keys[a] ^ keys[b]) <= budget)
            forest.join(a[near], b[near])
            go = ~leaf
            alo, ahi, blo, bhi, diff = alo[go], ahi[go], blo[go], bhi[go], diff[go]
        if not len(alo):
            return
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - level)) & np.uint64(1))])
        ones = ones.astype(np.int64)
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = (alo == blo) & (ahi == bhi)
        kids = [
            (alo, amid, blo, bmid, diff, None),
            (amid, ahi, bmid, bhi, diff, None),
            (alo, amid, bmid, bhi, diff + 1, None),
            (amid, ahi, blo, bmid, diff + 1, ~same),
        ]
        parts = []
        for l1, h1, l2, h2, d, only in kids:
            keep = (h1 > l1) & (h2 > l2) & (d <= budget)
            if only is not None:
                keep &= only
            parts.append([v[keep] for v in (l1, h1, l2, h2, d)])
        alo, ahi, blo, bhi, diff = (np.concatenate(v) for v in zip(*parts, strict=True))


def _top(key: Column, bits: Column | int) -> Column:
    """The first ``bits`` (1 to 64) bits of a 64-bit key, as a number."""
    shift = F.lit(64) - bits
    return F.call_function("shiftrightunsigned", key, shift.cast("int"))


def _opened(
    hot: DataFrame, nodes: DataFrame, budget: int, node_rows: int, first_bits: int
) -> DataFrame:
    """Pairs (turn, bits, a, b) whose nodes hold at most ``node_rows``, from hot starting nodes.

    ``hot``: (turn, node) at ``first_bits``; ``nodes``: (turn, key) of their members.
    """
    bits = first_bits
    pairs = hot.select("turn", F.col("node").alias("a"), F.col("node").alias("b"),
                       F.lit(0).alias("diff"))
    done = None
    while True:
        more = min(64, bits + 8)
        counts = store(
            nodes.groupBy("turn", _top(F.col("key"), more).alias("node")).agg(
                F.count(F.lit(1)).alias("n")
            ).withColumn("up", F.call_function("shiftrightunsigned", "node", F.lit(more - bits))),
            "trie-nodes",
        )
        left = counts.select("turn", F.col("up").alias("a"), F.col("node").alias("a2"),
                             F.col("n").alias("na"))
        right = counts.select("turn", F.col("up").alias("b"), F.col("node").alias("b2"),
                              F.col("n").alias("nb"))
        low = F.lit((1 << (more - bits)) - 1)
        apart = F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(low))
        kids = store(
            pairs.join(left, ["turn", "a"]).join(right, ["turn", "b"])
            .withColumn("diff", F.col("diff") + apart)
            .filter((F.col("diff") <= budget) & ((F.col("a") != F.col("b"))
                                                | (F.col("a2") <= F.col("b2"))))
            .select("turn", F.col("a2").alias("a"), F.col("b2").alias("b"), "diff",
                    ((F.col("na") <= node_rows) & (F.col("nb") <= node_rows)
                     | F.lit(more == 64)).alias("small")),
            "trie-pairs",
        )
        ready = kids.filter("small").select("turn", F.lit(more).alias("bits"), "a", "b")
        done = ready if done is None else done.unionByName(ready)
        pairs, bits = kids.filter("not small").drop("small"), more
        if bits == 64 or pairs.isEmpty():
            return done


def fingerprint_links(
    fps: DataFrame, *, budget: int = BUDGET, node_rows: int = NODE_ROWS
) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) that connect all near ones.

    Two fingerprints within the budget are always in one component of the links; a link may stand
    for a chain of near pairs inside one task.
    """
    spark = fps.sparkSession
    small_batches(spark, 10_000)
    blocks = budget + 1
    first = 64 // blocks
    turned = F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("turn")
    turns = fps.select("fp", turned).withColumn("move", F.col("turn") * first)
    rotated = F.when(F.col("move") == 0, F.col("fp")).otherwise(
        F.call_function("shiftleft", F.col("fp"), F.col("move")).bitwiseOR(
            F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64) - F.col("move"))
        )
    )
    keys = turns.select("turn", rotated.alias("key")).withColumn("node", _top(F.col("key"), first))
    keys = store(keys, "trie-keys")
    sizes = keys.groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n"))
    hot = store(sizes.filter(F.col("n") > node_rows).select("turn", "node"), "trie-hot")
    plain = keys.join(hot, ["turn", "node"], "left_anti").join(
        sizes.filter((F.col("n") > 1) & (F.col("n") <= node_rows)).select("turn", "node"),
        ["turn", "node"], "left_semi",
    ).select(
        F.xxhash64("turn", "node", F.lit(0)).alias("task"), F.lit(0).alias("side"), "key", "turn"
    )
    tasks = plain
    if not hot.isEmpty():
        inside = store(keys.join(hot, ["turn", "node"], "left_semi").select("turn", "key"), "trie-in")
        pairs = store(_opened(hot, inside, budget, node_rows, first), "trie-tasks").withColumn(
            "task", F.xxhash64("turn", "bits", "a", "b")
        )
        sides = pairs.select("task", "turn", "bits", F.lit(0).alias("side"), F.col("a").alias("node"))
        sides = sides.unionByName(
            pairs.filter("a <> b").select(
                "task", "turn", "bits", F.lit(1).alias("side"), F.col("b").alias("node")
            )
        )
        depths = sides.select("turn", "bits", "node").distinct()
        at = F.explode(F.array(*[F.lit(b) for b in [*range(first + 8, 64, 8), 64]])).alias("bits")
        members = inside.select("turn", "key", at).withColumn("node", _top(F.col("key"), F.col("bits")))
        # Only nodes that are a side of a task keep their members.
        members = members.join(depths, ["turn", "bits", "node"], "left_semi")
        tasks = plain.unionByName(
            members.join(sides, ["turn", "bits", "node"]).select("task", "side", "key", "turn")
        )

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        task, side, turn = (table.column(c).to_numpy() for c in ("task", "side", "turn"))
        key = table.column("key").to_numpy().view("u8")
        order = np.lexsort((key, side, task))
        task, side, turn, key = task[order], side[order], turn[order], key[order]
        new = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (side[1:] != side[:-1])])
        ends = np.r_[new[1:], len(key)]
        # A task has one run (joined with itself) or two (joined with each other).
        begins = np.flatnonzero(np.r_[True, task[new][1:] != task[new][:-1]])
        lasts = np.r_[begins[1:], len(new)] - 1
        pairs = np.stack([new[begins], ends[begins], new[lasts], ends[lasts]], axis=1)
        move = (turn * first).astype(np.uint64)
        fp = np.where(move == 0, key, (key >> move) | (key << ((np.uint64(64) - move) % np.uint64(64))))
        forest = Forest(len(key))
        # One fingerprint may stand in several tasks of the partition.
        by_fp = np.argsort(fp, kind="stable")
        same = fp[by_fp][1:] == fp[by_fp][:-1]
        walk(key, pairs, budget, forest)
        forest.join(by_fp[1:][same], by_fp[:-1][same])
        roots = fp[forest.roots()]
        linked = np.flatnonzero(roots != fp)
        a, b = fp[linked].view("i8"), roots[linked].view("i8")
        both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), "i8")
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return tasks.repartition("task").mapInArrow(join, "a long, b long")


def near_duplicates(rows: DataFrame, *, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``rows`` (doc_id, fp), component_id the smallest
    doc_id reachable over links of at most ``budget`` differing bits, itself included."""
    classes = store(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes"
    )
    parts = store(components(fingerprint_links(classes.select("fp"), budget=budget)), "simhash-parts")
    of_class = classes.join(parts, classes.fp == parts.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    names = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one of the smallest id."""
    spark = docs.sparkSession
    small_batches(spark)
    whole = store(
        docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_uid")),
        "simhash-docs",
    )
    # The row number rides along as the id, so that repeated ids stay apart.
    fps = store(
        fingerprints(
            whole.select("_uid", F.col(f"_row.{id_col}").alias("_id"), F.col(f"_row.{text_col}").alias("_text")),
            "_uid", "_text",
        ).join(whole.select(F.col("_uid").alias("doc_id"), F.col(f"_row.{id_col}").alias("id")), "doc_id"),
        "simhash-rows",
    )
    parts = near_duplicates(fps.select("doc_id", "fp"))
    best = parts.join(fps.select("doc_id", "id"), "doc_id").groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "doc_id")).alias("top")
    )
    return whole.join(
        best.select(F.col("top.doc_id").alias("_uid")), "_uid", "left_semi"
    ).select("_row.*")
