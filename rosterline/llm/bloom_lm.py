"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count ``c`` has level ``1 + floor(log_base c)``, and an n-gram is entered into the filter once for
every level up to its own. A lookup probes level 1, 2, ... until one is missing: counts are read
back as the middle of the last level found, never too small, and too large only by a false hit.
The probability of a token is smoothed through the orders: ``(c(h w) + prior * P(w | shorter h)) /
(c(h) + prior)``, and ``(c(w) + 1) / (N + V + 1)`` for a single token. ``c(h)`` is the filter's count of
the n-gram that ends one place earlier, so contexts need no entries of their own.

Scale: n-grams are counted inside tasks, packed as sorted keys, and shuffled once to units of the
filter; the number of units follows the number of tokens, so a unit has a fixed expected size, and its
bits follow its own entries. Nothing is pruned. Units are broadcast in shards of at most
``shard_bytes`` each; a task holds one shard at a time. At most ``round_bytes`` of shards are broadcast
at once: a larger filter is probed in rounds, whose levels are written to the shared folder.

Exact counts of words serve the base score. Words that make up at least one token in ``COMMON`` are at
most ``COMMON`` many, whatever the corpus; they are broadcast, and only the other words of a document are
joined with the counts, which also keeps every hot word out of that shuffle.

Nulls: a null text is empty and consists of the end token; a row with a null id is scored and, having
no fold, not held out. Repeated rows are counted and scored by themselves. Texts of any length are read
in pieces of bounded size; a word without white space is one token however long. Without any training
row all probabilities are 1. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, store, text_of

#: N-gram length, base of the count levels, bits and probes for each entry, weight of the shorter context.
ORDER, BASE, BITS, PROBES, PRIOR = 2, 2.0, 10, 4, 16.0
UNIT_TOKENS = 1 << 19
SHARD_BYTES, ROUND_BYTES = 32 << 20, 512 << 20
COMMON = 1 << 17
#: Bytes of text worked on at once; words kept in a worker before its table is begun anew.
PIECE, WORDS = 2 << 20, 300_000
END = b""
START_KEY = np.uint64(0x5851F42D4C957F2D)
SPACE = b" \t\n\r\x0b\x0c"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


# --- texts in pieces --------------------------------------------------------

def pieces(raw: bytes, room: int) -> Iterator[tuple[bytes, bool]]:
    """Parts of a text, cut at white space, of about ``room`` bytes, and whether it is the last one."""
    begin = 0
    while len(raw) - begin > room:
        ends = [at for at in (raw.find(bytes([c]), begin + room) for c in SPACE) if at >= 0]
        if not ends:
            break
        yield raw[begin : min(ends)], False
        begin = min(ends)
    yield raw[begin:], True


class Words:
    """Numbers of the tokens met, with the hash (and the common count) of each in arrays."""

    def __init__(self, common: dict[bytes, int] | None = None) -> None:
        self.common = common or {}
        self.begin()

    def begin(self) -> None:
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.tokens: list[bytes] = []
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.number)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))

    def describe(self) -> None:
        """Fill in the tokens that were met since."""
        from xxhash import xxh64_intdigest

        new = list(islice(self.number, len(self.tokens), None))
        self.tokens += new
        hashes = np.fromiter(map(xxh64_intdigest, new), np.uint64, len(new))
        self.hashes = np.concatenate([self.hashes, hashes])
        if self.common:
            counts = np.fromiter((self.common.get(t, 0) for t in new), np.int64, len(new))
        else:
            counts = np.zeros(len(new), np.int64)
        self.counts = np.concatenate([self.counts, counts])


class Block:
    """Tokens of several pieces in one array, each after the ``order - 1`` tokens before it.

    ``ids`` numbers the tokens (-1: start of a text), ``own`` marks those that are counted here, the
    others only being context, and ``doc`` is the row that a token belongs to. ``spans`` has the row of
    every piece and the places of its tokens in the text, context included.
    """

    def __init__(self, parts: list[tuple], words: Words, order: int) -> None:
        lead = order - 1
        words.describe()
        ids, own, doc = [], [], []
        self.spans = [(row, at - lead, at + len(tokens)) for row, at, _, tokens in parts]
        for row, _, before, tokens in parts:
            ids += [before, tokens]
            own += [np.zeros(lead, bool), np.ones(len(tokens), bool)]
            doc.append(np.full(lead + len(tokens), row))
        self.ids, self.own, self.doc = (np.concatenate(x) for x in (ids, own, doc))
        self.start = self.ids < 0
        hashes = np.where(self.start, START_KEY, words.hashes[self.ids])
        self.keys: list[np.ndarray] = []
        key = np.zeros_like(hashes)
        for k in range(order):
            # Hash of the k + 1 tokens that end here, begun with the last one.
            far = np.concatenate([np.full(k, START_KEY), hashes[: len(hashes) - k]])
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + far + np.uint64(k + 1))
            self.keys.append(key)


def blocks(batches: Iterator, words: Words, order: int) -> Iterator[tuple]:
    """Yield (Block, batch, its first row, one past its last row that ends in the block)."""
    nothing = np.full(order - 1, -1)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        parts, size, first = [], 0, 0
        for row in range(len(column)):
            before, at = nothing, 0
            for piece, last in pieces(column[row].as_py(), PIECE):
                if size + len(piece) > PIECE and parts:
                    yield Block(parts, words, order), batch, first, row
                    parts, size, first = [], 0, row
                    if len(words) > WORDS:
                        kept = [words.tokens[i] if i >= 0 else None for i in before]
                        words.begin()
                        before = np.array([-1 if t is None else words.number[t] for t in kept], dtype=np.int64)
                tokens = piece.lower().split()
                if last:
                    tokens.append(END)
                ids = words.ids(tokens)
                parts.append((row, at, before, ids))
                at += len(ids)
                before = np.concatenate([before, ids])[len(ids) :]
                size += len(piece) + 1
        if parts:
            yield Block(parts, words, order), batch, first, len(column)
        if len(words) > WORDS:
            words.begin()


# --- counting ---------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(token, n): exact counts of all tokens of ``text`` (binary), the end of a text among them."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, sums = Words(), np.zeros(0, np.int64)

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(words.tokens, pa.binary()), pa.array(sums)], ["token", "n"]
            )

        for block, *_ in blocks(batches, words, 1):
            found = np.bincount(block.ids, minlength=len(words))
            found[: len(sums)] += sums
            sums = found
            if len(words) > WORDS:
                yield flushed()
                words.begin()
                sums = np.zeros(0, np.int64)
        yield flushed()

    parts = texts.select("text").mapInArrow(count, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def unit_of(keys: np.ndarray, units: int) -> np.ndarray:
    """Unit of a key; it grows with the key, so that sorted keys stand by unit."""
    return ((keys >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)


def _packed(keys: np.ndarray, counts: np.ndarray, units: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Sorted keys with their counts by unit: keys seen once, repeated keys, counts of these."""
    unit = unit_of(keys, units)
    begin = 0
    for end in np.flatnonzero(np.diff(unit, append=-1)) + 1:
        k, c = keys[begin:end], counts[begin:end]
        often = c > 1
        yield int(unit[begin]), k[~often].tobytes(), k[often].tobytes(), c[often].astype(np.uint32).tobytes()
        begin = end


def gram_counts(texts: DataFrame, units: int, order: int = ORDER) -> DataFrame:
    """Counts of all n-grams up to ``order``, packed: (unit, ones, keys, counts)."""
    kind = "unit int, ones binary, keys binary, counts binary"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, held, size = Words(), [], 0
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def flushed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            columns = list(zip(*_packed(keys, counts, units), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                [c.split()[0] for c in kind.split(", ")],
            )

        for block, *_ in blocks(batches, words, order):
            # Single words have one key each: their counts need no sorting of places.
            own = block.ids[block.own]
            place = np.full(len(words), -1)
            place[own] = np.flatnonzero(block.own)
            place = place[place >= 0]
            by_key = np.argsort(block.keys[0][place])
            place = place[by_key]
            yield flushed(block.keys[0][place], np.bincount(own)[block.ids[place]])
            held += [key[block.own] for key in block.keys[1:]]
            size += sum(len(x) for x in held[len(held) - order + 1 :])
            if size > 8 * WORDS:
                yield flushed(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if size:
            yield flushed(*np.unique(np.concatenate(held), return_counts=True))

    return texts.select("text").mapInArrow(count, kind)


# --- the filter -------------------------------------------------------------

@cache
def level_steps(base: float) -> np.ndarray:
    """Least count of every level."""
    return np.array([math.ceil(base**j - 1e-9) for j in range(int(63 / math.log2(base)))], dtype=np.float64)


@cache
def middle(base: float) -> np.ndarray:
    """The count that a level stands for: the middle of those that have it, 0 for none."""
    level = np.arange(256.0)
    with np.errstate(over="ignore"):
        counts = np.maximum(1.0, (base ** (level - 1) + base**level - 1) / 2)
    counts[0] = 0.0
    return counts


def slots(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot of (key, level) and the step to its next ones, before they are cut to a unit's bits."""
    first = mixed(keys + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    return first, mixed(first) | np.uint64(1)


def build_units(grams: DataFrame, base: float = BASE, bits: int = BITS) -> DataFrame:
    """(unit, entries, size, filter) from packed counts; ``size`` is the unit's number of bits."""
    hashes = PROBES

    def build(table):  # noqa: ANN001, ANN202  (pyarrow is imported in workers)
        import pyarrow as pa

        blobs = {c: [b for b in table[c].to_pylist() if b] for c in ("ones", "keys", "counts")}
        ones, keys = (np.frombuffer(b"".join(blobs[c]), np.uint64) for c in ("ones", "keys"))
        counts = np.frombuffer(b"".join(blobs["counts"]), np.uint32)
        keys = np.concatenate([ones, keys])
        counts = np.concatenate([np.ones(len(ones), np.int64), counts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        levels = np.searchsorted(level_steps(base), counts, side="right")
        entries = int(levels.sum())
        size = -(-entries * bits // 64) * 64
        field = np.zeros(size, bool)
        for level in range(1, levels.max() + 1):
            slot, step = slots(keys[levels >= level], level)
            for _ in range(hashes):
                field[slot % np.uint64(size)] = True
                slot = slot + step
        return pa.table({
            "unit": pa.array([table["unit"][0].as_py()], pa.int32()),
            "entries": pa.array([entries], pa.int64()),
            "size": pa.array([size], pa.int64()),
            "filter": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary()),
        })

    return grams.groupBy("unit").applyInArrow(build, "unit int, entries long, size long, filter binary")


class Shard:
    """Consecutive units of a filter in one array of bytes; a unit without entries has one empty word."""

    def __init__(self, first: int, last: int, rows: list) -> None:
        self.first, self.last = first, last
        held = {r.unit: r for r in rows}
        empty = bytes(8)
        parts = [held[u].filter if u in held else empty for u in range(first, last + 1)]
        self.sizes = np.array([8 * len(x) for x in parts], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.filter = np.frombuffer(b"".join(parts), np.uint8)

    def probe(self, keys: np.ndarray, units: np.ndarray, hashes: int, levels: np.ndarray) -> None:
        """Enter the levels of the keys (of the given units) that belong to this shard."""
        open_, level = np.flatnonzero((units >= self.first) & (units <= self.last)), 1
        at = units - self.first
        while len(open_):
            slot, step = slots(keys[open_], level)
            for _ in range(hashes):
                mine = at[open_]
                bit = self.starts[mine] + slot % self.sizes[mine]
                byte = self.filter[bit >> np.uint64(3)]
                hit = (byte >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                open_, slot, step = open_[hit], slot[hit], step[hit]
                slot = slot + step
            levels[open_] = level
            level += 1


def shard_plan(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Units in order, in groups of at most ``limit`` bytes (a group has one unit at least)."""
    groups: list[list[int]] = []
    room = 0
    for unit, size in sorted(sizes):
        need = size // 8
        if not groups or need > room:
            groups.append([])
            room = limit
        groups[-1].append(unit)
        room -= need
    return groups


class Model:
    """Trained counts: the exact vocabulary and the units of the filter, both written tables."""

    def __init__(self, vocabulary: DataFrame, units: DataFrame | None, n_units: int, **settings) -> None:  # noqa: ANN003
        self.vocabulary, self.units, self.n_units = vocabulary, units, n_units
        self.order, self.base, self.bits = settings["order"], settings["base"], settings["bits"]
        n, v, ends = vocabulary.agg(
            F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.octet_length("token") == 0, F.col("n")))
        ).first()
        self.tokens, self.distinct, self.texts = n or 0, v, ends or 0


def train(
    texts: DataFrame, *, order: int = ORDER, base: float = BASE, bits: int = BITS, unit_tokens: int = UNIT_TOKENS
) -> Model:
    """Counts of all texts (``text`` as binary): vocabulary and filter."""
    ship_package(texts.sparkSession)
    vocabulary = store(word_counts(texts), "lm-vocabulary")
    tokens = vocabulary.agg(F.sum("n")).first()[0] or 0
    n_units = max(1, -(-tokens // unit_tokens))
    units = store(build_units(gram_counts(texts, n_units, order), base, bits), "lm-filter")
    return Model(vocabulary, units, n_units, order=order, base=base, bits=bits)


# --- scores -----------------------------------------------------------------

def log_probability(block: Block, levels: list[np.ndarray], model: dict) -> np.ndarray:
    """log10 of the smoothed probability of every token of a block."""
    counts = [np.where(block.start, model["texts"], middle(model["base"])[level]) for level in levels]
    p = (counts[0] + 1) / (model["tokens"] + model["distinct"] + 1)
    for k in range(1, len(levels)):
        held = np.concatenate([[0.0], counts[k - 1][:-1]])
        p = (np.minimum(counts[k], held) + model["prior"] * p) / (held + model["prior"])
    return np.log10(p)


SCORED = "n_tokens long, n_common long, common_sum double, model double, rare array<struct<token: binary, n: long>>"


def score_texts(
    texts: DataFrame, model: Model, *, prior: float = PRIOR,
    shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``texts`` (``text`` as binary and further columns, no text) with n_tokens, n_known, base_score, score."""
    spark = texts.sparkSession
    ship_package(spark)
    context, order, units = spark.sparkContext, model.order, model.n_units
    hashes = PROBES
    common = {
        bytes(r.token): r.n for r in model.vocabulary.filter(F.col("n") >= model.tokens / COMMON).collect()
    }
    common_words = context.broadcast(common)
    facts = {
        "tokens": model.tokens, "distinct": model.distinct, "texts": model.texts,
        "base": model.base, "prior": prior,
    }
    plan = shard_plan([tuple(r) for r in model.units.select("unit", "size").collect()], shard_bytes)
    a_round = max(1, round_bytes // shard_bytes)
    rounds = [plan[i : i + a_round] for i in range(0, len(plan), a_round)] or [[]]
    kept = [c for c in texts.columns if c != "text"]
    now = texts.withColumn("levels", F.lit(None).cast("binary"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")

    for number, groups in enumerate(rounds):
        shards = [
            context.broadcast(Shard(g[0], g[-1], model.units.filter(F.col("unit").between(g[0], g[-1])).collect()))
            for g in groups
        ]
        last = number == len(rounds) - 1

        def probe(batches: Iterator, shards: list = shards, last: bool = last) -> Iterator:
            import pyarrow as pa

            words = Words(common_words.value)
            sums, open_rows = Sums(), {}
            for block, batch, first, end in blocks(batches, words, order):
                levels = _levels(block, batch, words, shards, order, units, hashes)
                if last:
                    scores = sums.add(block, log_probability(block, levels, facts), words, end - first)
                    out = batch.slice(first, end - first)
                    arrays = [out.column(batch.schema.get_field_index(c)) for c in kept]
                    names = [*kept, "n_tokens", "n_common", "common_sum", "model", "rare"]
                    yield pa.RecordBatch.from_arrays([*arrays, *scores], names)
                else:
                    raw = np.stack(levels, axis=1).astype(np.uint8)[block.own]
                    doc = block.doc[block.own]
                    for row in range(first, int(block.doc[-1]) + 1):
                        open_rows.setdefault(row, []).append(raw[doc == row].tobytes())
                    done = [b"".join(open_rows.pop(row)) for row in range(first, end)]
                    out = batch.slice(first, end - first)
                    arrays = [out.column(i) for i, c in enumerate(batch.schema.names) if c != "levels"]
                    names = [c for c in batch.schema.names if c != "levels"]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(done, pa.binary())], [*names, "levels"])

        if last:
            scored = now.mapInArrow(probe, f"{types}, {SCORED}" if types else SCORED)
            scored = store(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
        else:
            order_of = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema if f.name != "levels"
            )
            now = store(now.mapInArrow(probe, f"{order_of}, levels binary"), "lm-levels")
        for shard in shards:
            shard.unpersist()
    return _with_base(scored, model, kept)


def _levels(
    block: Block, batch, words: Words, shards: list, order: int, units: int, hashes: int  # noqa: ANN001
) -> list[np.ndarray]:
    """Count levels of a block's n-grams, from the shards of this round and those of earlier rounds."""
    # One place of every word of the block; the start of a text comes last.
    place = np.full(len(words) + 1, -1)
    place[block.ids] = np.arange(len(block.ids))
    met = np.flatnonzero(place >= 0)
    keys, back = np.unique(np.concatenate([block.keys[0][:0], *block.keys[1:]]), return_inverse=True)
    asked = np.concatenate([block.keys[0][place[met]], keys])
    found, unit = np.zeros(len(asked), np.uint8), unit_of(asked, units)
    for shard in shards:
        shard.value.probe(asked, unit, hashes, found)
        if len(shards) > 1 and hasattr(shard, "_value"):
            del shard._value  # read again from the worker's disk when it is asked for
    of_word = np.zeros(len(place), np.uint8)
    of_word[met] = found[: len(met)]
    longer = found[len(met) :][back].reshape(order - 1, len(block.ids))
    levels = np.concatenate([of_word[block.ids][None], longer])
    column = batch.column(batch.schema.get_field_index("levels"))
    if column.null_count == 0:
        early = []
        for row, begin, end in block.spans:
            known = np.frombuffer(column[row].as_py(), np.uint8).reshape(-1, order)[max(begin, 0) : end]
            early += [np.zeros((max(-begin, 0), order), np.uint8), known]
        levels = np.maximum(levels, np.concatenate(early).T)
    return list(levels)


class Sums:
    """Sums by row over blocks; a row that goes on in the next block is held until it ends."""

    def __init__(self) -> None:
        self.open: tuple | None = None

    def add(self, block: Block, logs: np.ndarray, words: Words, done: int) -> list:
        """Arrow arrays of the ``done`` rows that end in this block: n_tokens, n_common, common_sum, model, rare."""
        import pyarrow as pa

        own = block.own
        rows, ids = block.doc[own] - block.doc[0], block.ids[own]
        size = int(block.doc[-1] - block.doc[0]) + 1
        count = words.counts[ids]
        often = count > 0
        sums = [
            np.bincount(rows, minlength=size), np.bincount(rows[often], minlength=size),
            np.bincount(rows[often], np.log10(count[often] + 1.0), size).astype(np.float64),
            np.bincount(rows, logs[own], size).astype(np.float64),
        ]
        pairs, times = np.unique((rows[~often] << 32) | ids[~often], return_counts=True)
        at, which = pairs >> 32, pairs & 0xFFFFFFFF
        tokens = [words.tokens[i] for i in which.tolist()]
        if self.open is not None:
            for values, before in zip(sums, self.open[0], strict=True):
                values[0] += before
            at = np.concatenate([np.zeros(len(self.open[1]), at.dtype), at])
            tokens, times = self.open[1] + tokens, np.concatenate([self.open[2], times])
        ends = np.searchsorted(at, np.arange(done + 1))
        cut = int(ends[-1])
        self.open = ([v[done] for v in sums], tokens[cut:], times[cut:]) if size > done else None
        rare = pa.StructArray.from_arrays([pa.array(tokens[:cut], pa.binary()), pa.array(times[:cut])], ["token", "n"])
        return [
            *[pa.array(v[:done]) for v in sums],
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rare),
        ]


def _with_base(scored: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """Join the rare words of every row with their exact counts, and finish the base score."""
    total = math.log10(model.tokens + model.distinct + 1)
    rare = scored.select("_row", F.explode("rare").alias("_r")).select("_row", F.col("_r.token").alias("token"), F.col("_r.n").alias("times"))
    found = rare.join(model.vocabulary, "token").groupBy("_row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_sum")
    )
    return scored.join(found, "_row", "left").select(
        *[F.col(c) for c in kept],
        "n_tokens",
        (F.col("n_common") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("common_sum") + F.coalesce("_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        F.col("model").alias("score"),
    )


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text falls into the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_model_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, fold: int = 2,
    order: int = ORDER, base: float = BASE, bits: int = BITS, prior: float = PRIOR,
    unit_tokens: int = UNIT_TOKENS, shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all documents outside the held-out fold.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"),
        text_of(text_col).cast("binary").alias("text"),
    )
    model = train(rows.filter("not held_out"), order=order, base=base, bits=bits, unit_tokens=unit_tokens)
    return score_texts(
        rows, model, prior=prior, shard_bytes=shard_bytes, round_bytes=round_bytes
    ).withColumnRenamed("id", id_col)
