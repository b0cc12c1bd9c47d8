"""Repair of conversation structure at least cost, by Four-Russians block tables.

A conversation must read ``(s?(ua)+)?`` in role initials: an automaton of four states (begun, after the
system, user, assistant row). The cost to finish from every state is a vector of four numbers; what
matters is the vector less its minimum, and only few such normalised vectors can occur. For every one of
them and every block of ``BLOCK`` symbols the vector before the block and the cost that is added are
computed once in a worker; a conversation is then processed from its end, a block a lookup. Vectors at the
block borders are kept. The edits are traced from the front: a block is expanded backward from the vector
behind it, and of all cheapest edits the one with the least letter is taken, so ties need no search.

Scale: rows of a conversation are ordered by a range sort of narrow rows (id, turn, digest, symbol, and the
number of equal rows), so one conversation may spread over many tasks; a task gives one byte per row. The
symbols of a conversation, which are no more than the letters of its audit cell, meet in one task; texts
do not. The final digest is one SHA-256 stream per conversation by definition: the task that computes it
reads the sorted rows of a conversation one by one and holds none, so memory is bounded there, time is not
spread for a single hot conversation.

Nulls: a null role or text counts as one space, and so does a null id or turn inside the damage key. A
null conversation id is a conversation of its own. Rows are taken by turn, null turns first; rows of one
turn by the SHA-256 of role and text after damage. A row with an empty role has no initial, and keeping it
leaves the state as it is. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, store

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4
#: Initials that the automaton knows; any other one comes after them, then the empty role.
INITIALS = "sua"
OTHER, EMPTY, CLASSES = 3, 4, 5
#: Faults of a row, and the symbol of a row that must go, whatever its role.
FINE, CUT, BLANK, COPY = range(4)
GONE = 2 * CLASSES
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: State after a row of class 0, 1, 2 (s, u, a); None where it is not allowed.
NEXT = [(1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None)]
#: State that an inserted or reroled row leads to: the only legal one of user and assistant.
GROWN = [2, 2, 3, 2]
ROLES = {2: "user", 3: "assistant"}
#: Cost and letters from a state to an allowed end.
CLOSING = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


def symbol(code: int) -> int:
    """Symbol of the automaton from class * 4 + fault."""
    kind, fault = divmod(code, 4)
    return GONE if fault >= BLANK else 2 * kind + (fault == CUT)


def choices(sym: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of the edits that consume a row, least letter first."""
    out = [("D", DELETE + after[state], state)]
    if sym != GONE:
        kind, cut = divmod(sym, 2)
        kept = state if kind == EMPTY else None if kind == OTHER else NEXT[state][kind]
        extra = TRUNCATED * cut
        if kept is not None:
            out.append(("K", extra + after[kept], kept))
        out.append(("R", REROLE + extra + after[GROWN[state]], GROWN[state]))
    return out


class Tables:
    """Transitions of normalised cost vectors: by symbol, by block, and the edits by symbol and state."""

    def __init__(self, block: int = BLOCK) -> None:
        first = tuple(cost for cost, _ in CLOSING)
        self.vectors: list[tuple[int, ...]] = [first]
        number = {first: 0}
        step, added, self.edits = [], [], []
        for vector in self.vectors:  # grows while it is read
            step.append([])
            added.append([])
            self.edits.append([])
            for sym in range(GONE + 1):
                raw = [min(cost for _, cost, _ in choices(sym, q, vector)) for q in range(4)]
                full = [min(raw[q], INSERT + raw[GROWN[q]], 2 * INSERT + raw[GROWN[GROWN[q]]]) for q in range(4)]
                low = min(full)
                new = tuple(cost - low for cost in full)
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
                step[-1].append(number[new])
                added[-1].append(low)
                self.edits[-1].append([self._least(sym, q, vector, full) for q in range(4)])
        self.step, self.added = step, added
        self.block = block
        # One more symbol in front at a time: entry [vector, s1 .. sT] from [vector, s2 .. sT].
        one_step, one_added = np.array(step), np.array(added)
        far, cost = np.arange(len(step))[:, None], np.zeros((len(step), 1), np.int64)
        for _ in range(block):
            grown = one_step[far]  # vector, s2.., s1
            more = cost[:, :, None] + one_added[far]
            far = grown.transpose(0, 2, 1).reshape(len(step), -1)
            cost = more.transpose(0, 2, 1).reshape(len(step), -1)
        self.far, self.cost = far.tolist(), cost.tolist()

    @staticmethod
    def _least(sym: int, state: int, after: tuple[int, ...], full: list[int]) -> tuple[str, int]:
        """Letters up to the row's own edit, and the state after it: the least among the cheapest."""
        letters = ""
        while True:
            best = full[state]
            edits = {letter: (cost, state_) for letter, cost, state_ in choices(sym, state, after)}
            if edits["D"][0] == best:
                return letters + "D", state
            if INSERT + full[GROWN[state]] == best:
                letters, state = letters + "I", GROWN[state]
                continue
            return next((letters + c, q) for c, (cost, q) in edits.items() if cost == best)


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def cheapest(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and audit of a conversation, given class * 4 + fault of every row."""
    t = tables(block)
    symbols = np.array([symbol(c) for c in range(4 * CLASSES)])[np.frombuffer(codes, np.uint8)]
    head = len(symbols) % block
    rest = symbols[head:].reshape(-1, block)
    keys = (rest @ (len(t.step[0]) ** np.arange(block - 1, -1, -1))).tolist()
    vector, total, border = 0, 0, [0]
    for key in reversed(keys):
        total += t.cost[vector][key]
        vector = t.far[vector][key]
        border.append(vector)
    border.reverse()  # the vector before every block, and the last one
    letters: list[str] = []
    state = None
    runs = [(symbols[:head].tolist(), border[0]), *zip(rest.tolist(), border[1:], strict=True)]
    for syms, behind in runs:
        inner = [behind]
        for sym in reversed(syms):
            inner.append(t.step[inner[-1]][sym])
        if state is None:  # the rows before the first block were not looked up yet
            for sym, after in zip(reversed(syms), inner, strict=False):
                total += t.added[after][sym]
            state = 0
            total += t.vectors[inner[-1]][0]
        for place, sym in enumerate(syms):
            more, state = t.edits[inner[len(syms) - 1 - place]][sym][state]
            letters.append(more)
    letters.append(CLOSING[state or 0][1])
    return total, "".join(letters)


# --- Spark ------------------------------------------------------------------

def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text) after the damage that the CRC-32 of id and turn asks for."""
    space = F.lit(" ")
    conv, turn = F.col(conv_col), F.col(turn_col)
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in (role_col, text_col))
    return rows.select(
        conv.alias("conv"), turn.alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(True), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def row_digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def symbols(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv, turn, digest, code, n): class * 4 + fault of the first of n equal rows."""
    initial = F.substring("role", 1, 1)
    kind = F.lit(OTHER)
    for i, c in enumerate(INITIALS):
        kind = F.when(initial == c, i).otherwise(kind)
    kind = F.when(F.col("role") == "", EMPTY).otherwise(kind)
    seen = r"[^\x20\x09-\x0D]"
    fault = (
        F.when(~F.col("text").rlike(seen), BLANK)
        .when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(CUT)
    )
    slim = rows.select("conv", "turn", row_digest().alias("digest"), (kind * 4 + fault).alias("code"))
    slim = store(
        slim.groupBy("conv", "turn", "digest", "code").agg(F.count(F.lit(1)).alias("n")), "repair-symbols"
    )
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = slim.groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(
        F.min(order).alias("_first")
    )
    joined = slim.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    later = (F.col("_first") != order) & (F.col("code") % 4 != BLANK)
    code = F.when(later, F.col("code") - F.col("code") % 4 + COPY).otherwise(F.col("code"))
    return joined.select("conv", "turn", "digest", code.cast("int").alias("code"), "n")


def _sequences(rows: DataFrame) -> DataFrame:
    """(conv, part, codes): the codes of the rows of a conversation in order, one row per task."""
    keys = ["conv", "turn", "digest"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, conv, held, begun = None, None, bytearray(), False

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], rows_type), pa.array([part], pa.int32()), pa.array([bytes(held)], pa.binary())],
                ["conv", "part", "codes"],
            )

        for batch in batches:
            rows_type = batch.schema.field("conv").type
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "part", "code", "n")]
            for c, p, code, n in zip(*values, strict=True):
                if begun and c != conv:
                    yield piece()
                    held.clear()
                conv, part, begun = c, p, True
                held.append(code)
                again = code if code % 4 == BLANK else code - code % 4 + COPY
                held.extend(bytes([again]) * (n - 1))
        if begun:
            yield piece()

    kind = dict(rows.dtypes)["conv"]
    return ordered.select("conv", F.spark_partition_id().alias("part"), "code", "n").mapInArrow(
        gather, f"conv {kind}, part int, codes binary"
    )


FIGURES = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _judged(sequences: DataFrame, kind: str) -> DataFrame:
    """Counts, cost and audit of every conversation, from its sequence of codes."""

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        legal = np.zeros((CLASSES, CLASSES), bool)
        for a, b in LEGAL:
            legal[a, b] = True
        for batch in batches:
            out: list[tuple] = []
            for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
                codes = b"".join(p["codes"] for p in parts)
                seen = np.frombuffer(codes, np.uint8)
                counts = np.bincount(seen % 4, minlength=4)
                role = seen // 4
                wrong = int((~legal[role[:-1], role[1:]]).sum())
                cost, audit = cheapest(codes)
                out.append((*(int(counts[f]) for f in (BLANK, COPY, CUT)), wrong, cost, audit))
            columns = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("conv")), *arrays], ["conv", *FIGURES, "audit"]
            )

    longs = ", ".join(f"{c} long" for c in FIGURES)
    grouped = sequences.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "codes"))).alias("parts"))
    return grouped.mapInArrow(judge, f"conv {kind}, {longs}, audit string")


def _written(rows: DataFrame, plans: DataFrame, kind: str) -> DataFrame:
    """``plans`` with the digest of every repaired conversation; rows follow their plan in one stream."""
    columns = [c for c in plans.columns if c != "conv"]
    nothing = [F.lit(None).cast(plans.schema[c].dataType).alias(c) for c in columns]
    void = F.lit(None).cast("binary").alias("digest")
    stream = plans.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                          void, *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], *columns)
    stream = stream.unionByName(rows.select(
        "conv", F.lit(1).alias("kind"), "turn", row_digest().alias("digest"), "role", "text", *nothing
    ))
    ordered = stream.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "digest")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        plan: dict | None = None
        letters, state, sha, begun = iter(""), 0, hashlib.sha256(), False

        def line(role: str, text: str) -> None:
            nonlocal begun
            sha.update(("\n" if begun else "").encode() + role.encode() + b":" + text.encode())
            begun = True

        def inserted(letter: str) -> str:
            nonlocal state
            while letter == "I":
                state = GROWN[state]
                line(ROLES[state], "")
                letter = next(letters, "")
            return letter

        def finished() -> dict:
            inserted(next(letters, ""))
            return plan | {"repaired_sha256": sha.hexdigest()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if plan is not None:
                        out.append(finished())
                    plan = {c: row[c] for c in ("conv", *columns)}
                    letters, state, sha, begun = iter(plan["audit"]), 0, hashlib.sha256(), False
                    continue
                letter, role = inserted(next(letters)), row["role"]
                if letter == "D":
                    continue
                if letter == "R":
                    state = GROWN[state]
                    role = ROLES[state]
                elif role:
                    state = NEXT[state][INITIALS.index(role[0])]
                line(role, row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(batch, columns))
        if plan is not None:
            yield pa.RecordBatch.from_pylist([finished()], schema=_arrow(batch, columns))

    def _arrow(batch, columns: list[str]):  # noqa: ANN001, ANN202
        import pyarrow as pa

        fields = [batch.schema.field(c) for c in ("conv", *columns)]
        return pa.schema([*fields, pa.field("repaired_sha256", pa.string())])

    types = ", ".join(f"{c} {plans.schema[c].dataType.simpleString()}" for c in columns)
    return ordered.mapInArrow(write, f"conv {kind}, {types}, repaired_sha256 string")


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", *, damage: bool = True,
) -> DataFrame:
    """One row per conversation: faults found, least cost, audit and digest of the repaired rows.

    With ``damage`` rows are first damaged by the CRC-32 of their id and turn. Returns id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    ship_package(conversations.sparkSession)
    if damage:
        rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    else:
        rows = conversations.select(
            F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
            *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
        )
    kind = dict(rows.dtypes)["conv"]
    slim = store(symbols(rows), "repair-rows")
    judged = _judged(_sequences(slim), kind).withColumnRenamed("conv", "_conv")
    turns = slim.select("conv", "turn").distinct().groupBy(F.col("conv").alias("_of")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps")
    )
    every = conversations.select(F.col(conv_col).alias("conv")).distinct()
    plans = every.join(judged, F.col("conv").eqNullSafe(F.col("_conv")), "left").join(
        turns, F.col("conv").eqNullSafe(F.col("_of")), "left"
    )
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *FIGURES)]
    plans = store(plans.select("conv", *numbers, F.coalesce("audit", F.lit("")).alias("audit")), "repair-plans")
    return _written(rows, plans, kind).withColumnRenamed("conv", conv_col)
