"""Near copies by SimHash at a stated Jaccard similarity of word shingles, every link verified.

The trie join of ``simhash`` compares whole tries, which prunes at three differing bits. Texts of
similarity 0.8 differ in ten of 64 bits, where a walk from the root prunes nothing. So here the
walks start from other nodes: documents whose sets agree in a band of ``ROWS`` minimum hashes, out
of ``BANDS`` bands. At similarity s a pair shares a start with probability 1 - (1 - s^5)^20, which
is 0.9996 at 0.8 and more above. The rest of the job is exact:

1. Equal shingle sets are one class. Bands with the same members are one bucket.
2. Every bucket's smallest class is compared with the others; links are verified. Most members of a
   large group are one component after this step, at one comparison a member.
3. Only classes of one bucket that still lie in different components are compared, in cells of
   about ``CELL`` classes by walks of the trie. Two cells of one component are no task, so a group of
   copies is not compared pair by pair, however large.
4. Pairs that the walk leaves within ``BUDGET`` bits and the size bound are verified by the exact
   Jaccard similarity of their shingle sets. A walk that leaves more pairs than it has rows lists
   none of them: the shingle sets come to its cells, and only links that join two components leave it.

Words and lower-casing are those of ``simhash``. Nulls: a null text is empty; empty texts are one
class. Ties: of a component the smallest id stays, a null id only if there is no other. Repeated
rows fall into one class. Very long texts are hashed whole, in pieces. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store, text_of
from .components import components
from .simhash import SEED, walk

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits a candidate may have: over three deviations above the mean at similarity 0.8.
BUDGET = 20
BANDS, ROWS = 20, 5
CELL = 512
#: Shingles whose minimum hashes are taken at once.
PIECE = 4096


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; a shorter text is one shingle, an empty one none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    span = min(shingle, len(words))
    spans = zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype="u8"))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes: bits set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for every band of minimum hashes."""
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(SEED)
    mask, factor = rng.integers(0, 2**64, (2, BANDS * ROWS, 1), dtype="u8")
    factor |= np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype="u8")
    for at in range(0, len(hashes), PIECE):
        mixed = (hashes[at : at + PIECE] ^ mask) * factor
        mixed ^= mixed >> np.uint64(32)
        mixed *= factor
        np.minimum(least, mixed.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(bands)], dtype="u8")
    return keys.view("i8").tolist()


def _sketches(texts: DataFrame) -> DataFrame:
    """(node, digest, n, fp, bands) of (node, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([majority(s) for s in sets], dtype="u8").view("i8")),
                    pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "digest", "n", "fp", "bands"],
            )

    return texts.mapInArrow(run, "node long, digest string, n long, fp long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of (node, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t).view("i8") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"]
            )

    return texts.mapInArrow(run, "node long, hashes array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the similarity; ``texts``: (node, text)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = store(_sets(texts.join(wanted, "node", "left_semi")), "near-sets")
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("ha") + F.size("hb")).alias("sum"))
        .filter(F.col("both") >= similarity * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


class _Found:
    """Collects the pairs of a walk that no component holds yet and whose sizes allow a link."""

    def __init__(self, comp: np.ndarray, n: np.ndarray, similarity: float) -> None:
        self.comp, self.n, self.similarity = comp, n, similarity
        self.pairs: list[np.ndarray] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        na, nb = self.n[a], self.n[b]
        keep = (self.comp[a] != self.comp[b]) & (
            np.minimum(na, nb) >= self.similarity * np.maximum(na, nb)
        )
        a, b = a[keep], b[keep]
        if len(a):
            self.pairs.append(np.stack([a, b], axis=1))


def _pairs_within(part: dict, budget: int, similarity: float) -> np.ndarray:
    """Pairs of rows of one task, sorted by side and fp, that the walk leaves."""
    key, side = part["fp"].view("u8"), part["side"]
    found = _Found(part["comp"], part["n"], similarity)
    half, end = int(np.searchsorted(side, 1)), len(key)
    run = [0, end, 0, end] if half == end else [0, half, half, end]
    walk(key, np.array([run]), budget, found)
    return np.concatenate(found.pairs) if found.pairs else np.zeros((0, 2), dtype=np.int64)


def _in_order(part: dict) -> dict:
    """The rows of one task by side and fingerprint."""
    order = np.lexsort((part["fp"].view("u8"), part["side"]))
    return {c: v[order] for c, v in part.items()}


TASK = ["task", "side", "fp", "node", "comp", "n"]


def _walked(tasks: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Pairs (task, a, b) of the tasks: rows (task, side, fp, node, comp, n), one task at a time.

    A task with more pairs than rows gives one row, whose a and b are null.
    """

    def solve(part: dict) -> Iterator:
        import pyarrow as pa

        part = _in_order(part)
        pairs, node, task = _pairs_within(part, budget, similarity), part["node"], part["task"][:1]
        if len(pairs) > len(node):
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(task), none, none], ["task", "a", "b"])
        elif len(pairs):
            pairs = np.unique(np.sort(node[pairs], axis=1), axis=0)
            columns = [np.repeat(task, len(pairs)), pairs[:, 0], pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["task", "a", "b"])

    def run(batches: Iterator) -> Iterator:
        held: dict | None = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in TASK}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in TASK}
            task = rows["task"]
            cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
            begins = np.r_[0, cuts]
            for a, b in zip(begins[:-1].tolist(), cuts.tolist(), strict=True):
                yield from solve({c: rows[c][a:b] for c in TASK})
            held = {c: rows[c][begins[-1] :] for c in TASK} if len(task) else held
        if held is not None:
            yield from solve(held)

    ordered = tasks.select(*TASK).repartition("task").sortWithinPartitions("task")
    return ordered.mapInArrow(run, "task long, a long, b long")


def forest_links(
    pairs: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], similarity: float
) -> list[tuple[int, int]]:
    """Those of the ``pairs`` of rows that reach the similarity and join two components not joined yet."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    held = [flat[e - len(s) : e] for s, e in zip(sets, ends.tolist(), strict=True)]
    size = np.array([len(s) for s in sets])
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    _, root = np.unique(comp, return_inverse=True)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    cuts = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
    out = []
    for part in np.split(pairs, cuts[1:]):
        a, others = int(part[0, 0]), part[:, 1]
        others = others[root[others] != root[a]]
        if not len(others):
            continue
        mark[held[a]] = True
        begins = np.r_[0, np.cumsum(size[others])[:-1]]
        both = np.add.reduceat(mark[np.concatenate([held[b] for b in others.tolist()])].astype(np.int64), begins)
        mark[held[a]] = False
        for b in others[both >= similarity * (size[a] + size[others] - both)].tolist():
            if root[b] != root[a]:
                root[root == root[b]] = root[a]
                out.append((a, b))
    return out


def _linked(tasks: DataFrame, sets: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Verified links (a, b) of tasks whose pairs are too many to list; ``sets``: (node, hashes)."""

    def solve(rows: list) -> Iterator:
        import pyarrow as pa

        table = pa.Table.from_batches(rows)
        part = {c: table.column(c).to_numpy() for c in TASK} | {"at": np.arange(len(table))}
        part = _in_order(part)
        pairs = _pairs_within(part, budget, similarity)
        if len(pairs):
            hashes = table.column("hashes").combine_chunks()
            flat, ends = hashes.values.to_numpy(), hashes.offsets.to_numpy()
            own = [flat[ends[i] : ends[i + 1]] for i in part["at"].tolist()]
            links = forest_links(pairs, part["comp"], own, similarity)
            found = np.sort(part["node"][np.array(links, dtype=np.int64).reshape(-1, 2)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator) -> Iterator:
        held: list = []
        for batch in batches:
            task = batch.column("task").to_numpy()
            edges = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for a, b in zip(edges, edges[1:]):
                if held and b > a and held[0].column("task")[0].as_py() != int(task[a]):
                    yield from solve(held)
                    held = []
                held += [batch.slice(a, b - a)] * (b > a)
        if held:
            yield from solve(held)

    ordered = tasks.join(sets, "node").select(*TASK, "hashes").repartition("task").sortWithinPartitions("task")
    return ordered.mapInArrow(run, "a long, b long")


def _tasks(members: DataFrame, cell: int) -> DataFrame:
    """Walks over cells of ``members`` (bucket, node, comp, fp, n) in buckets of several components.

    A component of more than ``cell`` members of a bucket has cells of its own; the others share
    cells. Pairs of cells of one component are left out.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    small = F.when(F.col("m") <= cell, F.col("m")).otherwise(0)
    mixed = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("comps"), F.sum(small).alias("rest")
    ).filter("comps > 1").drop("comps")
    own = F.col("m") > cell

    def part(key: str, total: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(F.col(total) / cell)))

    placed = store(
        members.join(sizes.join(mixed, "bucket"), ["bucket", "comp"]).select(
            "bucket", "node", "comp", "fp", "n",
            F.when(own, F.col("comp")).alias("mono"),
            F.when(own, F.xxhash64("comp", part("node", "m")))
            .otherwise(F.xxhash64(F.lit("rest"), part("comp", "rest"))).alias("cell"),
        ),
        "near-cells",
    )
    cells = placed.select("bucket", "cell", "mono").distinct()
    right = cells.select("bucket", F.col("cell").alias("cell_b"), F.col("mono").alias("mono_b"))
    pairs = cells.join(right, "bucket").filter(
        "cell <= cell_b and not coalesce(mono = mono_b, false)"
    ).withColumn("task", F.xxhash64("bucket", "cell", "cell_b"))
    sides = pairs.select("task", "bucket", "cell", F.lit(0).alias("side")).unionByName(
        pairs.filter("cell <> cell_b").select(
            "task", "bucket", F.col("cell_b").alias("cell"), F.lit(1).alias("side")
        )
    )
    return sides.join(placed, ["bucket", "cell"])


def near_groups(
    texts: DataFrame,
    *,
    similarity: float = SIMILARITY,
    budget: int = BUDGET,
    cell: int = CELL,
) -> DataFrame:
    """(node, component) per row of ``texts`` (node long, unique; text binary).

    Components of the links of at least ``similarity``; a component is named by its least node.
    """
    spark = texts.sparkSession
    small_batches(spark)
    sketches = store(_sketches(texts), "near-sketches")
    classes = store(
        sketches.groupBy("digest").agg(
            F.min("node").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"),
            F.first("bands").alias("bands"),
        ),
        "near-classes",
    )
    facts = classes.select(F.col("least").alias("node"), "n", "fp")
    bands = classes.select(F.explode("bands").alias("bucket"), F.col("least").alias("node"))
    buckets = bands.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("sign"),
        F.min("node").alias("rep"),
    ).filter("size > 1")
    once = buckets.groupBy("size", "sign", "rep").agg(F.min("bucket").alias("bucket"))
    members = store(
        bands.join(once.select("bucket", "rep"), "bucket").join(facts, "node"), "near-members"
    )

    first = facts.select(F.col("node").alias("rep"), F.col("n").alias("rep_n"), F.col("fp").alias("rep_fp"))
    stars = store(
        members.filter("node <> rep").select("rep", "node", "n", "fp").distinct().join(first, "rep")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("rep_fp"))) <= budget)
        .filter(F.least("n", "rep_n") >= similarity * F.greatest("n", "rep_n"))
        .select(F.col("rep").alias("a"), F.col("node").alias("b")),
        "near-stars",
    )
    links = store(verified(stars, texts, similarity), "near-links")
    settled = store(components(links), "near-settled")
    parted = members.join(settled, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    small_batches(spark, 10_000)
    tasks = _tasks(parted, cell)
    walked = store(_walked(tasks, budget, similarity), "near-pairs")
    others = walked.filter("a is not null").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    many = walked.filter("a is null").select("task")
    small_batches(spark)
    links = links.unionByName(store(verified(others, texts, similarity), "near-links"))
    if not many.isEmpty():
        many = store(tasks.join(many, "task", "left_semi"), "near-many")
        wanted = many.select("node").distinct()
        sets = store(_sets(texts.join(wanted, "node", "left_semi")), "near-sets")
        links = links.unionByName(store(_linked(many, sets, budget, similarity), "near-links"))
    parts = store(components(links), "near-parts")
    named = classes.join(parts, classes.least == parts.node, "left").select(
        "digest", F.coalesce("component", "least").alias("component")
    )
    return sketches.join(named, "digest").select("node", "component")


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    similarity: float = SIMILARITY,
    cell: int = CELL,
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of the smallest id."""
    whole = store(
        docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_uid")),
        "near-docs",
    )
    texts = whole.select(
        F.col("_uid").alias("node"), text_of(f"_row.{text_col}").cast("binary").alias("text")
    )
    ids = whole.select(F.col("_uid").alias("node"), F.col(f"_row.{id_col}").alias("id"))
    best = near_groups(texts, similarity=similarity, cell=cell).join(ids, "node").groupBy(
        "component"
    ).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("top"))
    kept = best.select(F.col("top.node").alias("_uid"))
    return whole.join(kept, "_uid", "left_semi").select("_row.*")
