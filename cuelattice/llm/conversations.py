"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``, by a time-major dynamic program.

A conversation's rows are cut into blocks of at most ``BLOCK`` rows, one byte a row. Blocks of one length are solved together: costs to go are
updated turn by turn for all of them, kept, and read forwards for the edits. A conversation of many blocks is solved by the least-cost
matrices of its blocks, so that no task holds more than a block of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable

#: Rows of one conversation that are solved in one piece.
BLOCK = 4096
#: Rows times conversations of one vectorised pass.
CELLS = 1 << 20

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
SPACE = r"\x20\x09-\x0D"
#: States: nothing said, system said, user said, assistant said, and one that no cost reaches. A state lets one role follow by insertion or new role.
START, SYSTEM, USER, ASSISTANT, DEAD = range(5)
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: State after a kept row by its initial (s, u, a, other) and the state before.
KEPT = np.array([[SYSTEM, DEAD, DEAD, DEAD], [USER, USER, DEAD, USER], [DEAD, DEAD, ASSISTANT, DEAD], [DEAD, DEAD, DEAD, DEAD]])
NEVER = 1 << 40
ACCEPT = np.array([0, NEVER, NEVER, 0, NEVER])
#: A row's byte: its initial, and these.
MUST_GO, CUT_OFF = 4, 8
#: A row's edit is one of these, plus 4 for each insert before it, plus 16 if the first role that it or its inserts take is the assistant's.
D, K, R = range(3)


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs ``(n, 5)`` after up to two inserts, of which a third is never of use."""
    for _ in range(2):
        cost[:, :4] = np.minimum(cost[:, :4], INSERT + cost[:, NEXT])
    return cost


def costs_to_go(rows: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``(turns + 1, n, 5)`` from row bytes ``(turns, n)`` and the costs ``(n, 5)`` after the last turn."""
    cost = np.full((len(rows) + 1, *end.shape), NEVER, np.int64)
    cost[-1] = _inserted(end.astype(np.int64))
    for t in range(len(rows) - 1, -1, -1):
        after, row = cost[t + 1], rows[t]
        stays = np.where(row & MUST_GO, NEVER, np.where(row & CUT_OFF, UNFINISHED, 0))[:, None]
        kept = np.take_along_axis(after, KEPT[row & 3], 1) + KEEP
        best = np.minimum(np.minimum(kept, after[:, NEXT] + REROLE) + stays, after[:, :4] + DELETE)
        cost[t, :, :4] = np.minimum(best, NEVER)
        _inserted(cost[t])
    return cost


def edits(rows: np.ndarray, cost: np.ndarray, entry: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits ``(turns + 1, n)`` of the cheapest ways with the least letters, and the states at the end. The last edit holds the inserts after all rows, of ``last`` blocks only."""
    n = np.arange(len(entry))
    state, out = entry.astype(np.int64), np.zeros((len(rows) + 1, len(entry)), np.int8)
    for t in range(len(rows) + 1):
        here, first, inserts = cost[t], NEXT[state] == ASSISTANT, np.zeros(len(entry), np.int8)
        for _ in range(2):
            least = here[n, state] == INSERT + here[n, NEXT[state]]
            if t < len(rows):
                least &= here[n, state] != DELETE + cost[t + 1][n, state]
            else:
                least &= last
            inserts += least
            state = np.where(least, NEXT[state], state)
        if t == len(rows):
            out[t] = 4 * inserts + 16 * first
            break
        now, after, row = here[n, state], cost[t + 1], rows[t]
        stays = np.where(row & MUST_GO, NEVER, np.where(row & CUT_OFF, UNFINISHED, 0))
        kept = KEPT[row & 3, state]
        letter = np.where(now == DELETE + after[n, state], D, np.where(now == KEEP + stays + after[n, kept], K, R))
        out[t] = letter + 4 * inserts + 16 * first
        state = np.where(letter == D, state, np.where(letter == K, kept, NEXT[state]))
    return out, state


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of blocks of one length, as many at a time as ``CELLS`` lets."""
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        step = max(1, CELLS // (int(lengths[part[0]]) + 1))
        yield from (part[i : i + step] for i in range(0, len(part), step))


def _solved(batch: pa.RecordBatch, names: list[str], work: Callable[..., dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """``work(rows (turns, n), index)`` over the buckets of a batch, its results put back in the batch's order; results of a row each are lists."""
    lists = batch.column("rows")
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    lengths = np.diff(offsets)
    out: dict[str, np.ndarray] = {name: np.empty(len(lengths), object) for name in names}
    for index in _buckets(lengths):
        turns = int(lengths[index[0]])
        rows = values[(offsets[index][None, :] + np.arange(turns)[:, None])] if turns else np.zeros((0, len(index)), np.int64)
        for name, found in work(rows, index).items():
            for i, value in zip(index, found, strict=True):
                out[name][i] = value
    return out


def _pass(blocks: DataFrame, schema: str, names: list[str], kinds: list[pa.DataType], work: Callable[[pa.RecordBatch], Callable[..., dict[str, np.ndarray]]]) -> DataFrame:
    """``(id, at)`` of every block with columns ``names``."""
    bounded_batches(blocks.sparkSession)
    id_type = blocks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _solved(batch, names, work(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), *(pa.array(list(found[n]), k) for n, k in zip(names, kinds, strict=True))], names=["id", "at", *names])

    return blocks.mapInArrow(run, f"id {id_type}, at bigint, {schema}")


def _many_blocks(blocks: DataFrame) -> DataFrame:
    """``(at, end, entry)`` of the blocks of conversations that have several: costs after the block and the state that it is entered in."""

    def crossing(batch: pa.RecordBatch):
        def work(rows: np.ndarray, index: np.ndarray) -> dict[str, np.ndarray]:
            end = np.full((4, 5), NEVER)
            end[np.arange(4), np.arange(4)] = 0
            found = [costs_to_go(rows, np.repeat(e[None], len(index), 0))[0, :, :4] for e in end]
            return {"matrix": np.stack(found, 2).reshape(len(index), 16)}

        return work

    def leaving(batch: pa.RecordBatch):
        ends = np.array(batch.column("end").to_pylist(), np.int64)

        def work(rows: np.ndarray, index: np.ndarray) -> dict[str, np.ndarray]:
            cost, no = costs_to_go(rows, ends[index]), np.zeros(len(index), bool)
            return {"exits": np.stack([np.where(cost[0, :, s] < NEVER, edits(rows, cost, np.full(len(index), s), no)[1], s) for s in range(4)], 1)}

        return work

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group, cost, ends = group.sort_values("at"), ACCEPT.copy(), []
        for matrix in reversed(group["matrix"].tolist()):
            ends.append(cost)
            cost = np.append(np.minimum((np.asarray(matrix).reshape(4, 4) + cost[None, :4]).min(1), NEVER), NEVER)
        return pd.DataFrame({"at": group["at"].to_numpy(), "end": [e.tolist() for e in reversed(ends)]})

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        group, state, entries = group.sort_values("at"), START, []
        for exits in group["exits"]:
            entries.append(state)
            state = int(exits[state])
        return pd.DataFrame({"at": group["at"].to_numpy(), "entry": entries})

    whole = pa.list_(pa.int64())
    ends = durable(_pass(blocks, "matrix array<bigint>", ["matrix"], [whole], crossing).groupBy("id").applyInPandas(backwards, "at long, end array<bigint>"))
    entries = _pass(blocks.join(ends, "at"), "exits array<bigint>", ["exits"], [whole], leaving).groupBy("id").applyInPandas(forwards, "at long, entry int")
    return ends.join(entries, "at")


def rows_in_order(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(at, id, turn, role, digest, copies, first, blank, cut_off)``: distinct rows of each conversation in the order of ``at``, without texts.

    Order is by turn, nulls first, then role and text. Null roles and texts are empty. ``copies`` counts equal rows, which follow each other;
    ``first`` says that no earlier turn holds the role and text. Rows are dealt by ranges of this order, so that a long conversation has many tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    said = F.regexp_extract(text, rf"(?s)([^{SPACE}])[{SPACE}]*\z", 1)
    me = F.struct(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"))
    flat = turns.select(me.alias("me"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"), F.substring(text, 1, 32).alias("head"), (said == "").alias("blank"), (~said.isin(".", "!", "?")).alias("cut_off"))
    rows = flat.groupBy("me", "role", "digest", "head", "blank", "cut_off").agg(F.count("*").alias("copies"))
    firsts = flat.groupBy(F.struct("me.id").alias("who"), "role", "digest").agg(F.min(F.struct(F.col("me.turn").isNotNull().alias("told"), F.col("me.turn").alias("turn"))).alias("f"))
    firsts = firsts.select(F.struct("who.id", "f.turn").alias("me"), "role", "digest", F.lit(True).alias("first"))
    order = ["me.id", "me.turn", "role", "head", "digest"]
    spread = rows.join(firsts, ["me", "role", "digest"], "left").repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = spread.select(F.monotonically_increasing_id().alias("at"), F.col("me.id").alias("id"), F.col("me.turn").alias("turn"), "role", "digest", "copies", F.coalesce("first", F.lit(False)).alias("first"), "blank", "cut_off")
    return durable(numbered)


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(id, at, rows)``: up to ``block`` successive rows of a conversation, a byte each, under the first one's place."""
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    byte = initial + F.when(F.col("blank") | ~F.col("first"), MUST_GO).otherwise(0) + F.when(F.col("cut_off"), CUT_OFF).otherwise(0)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    listed = F.array_sort(F.collect_list(F.struct("at", byte.cast("tinyint").alias("b"))))
    blocks = rows.groupBy("id", part.alias("part"), F.floor(place / block).alias("piece")).agg(F.min("at").alias("at"), listed.alias("l"))
    return durable(blocks.select("id", "at", F.transform("l", lambda x: x["b"]).alias("rows")))


def illegal_pairs(blocks: DataFrame) -> DataFrame:
    """``(id, illegal)``: neighbouring different rows whose initials are not su, ua or au. Copies of a row are not counted here."""
    legal = lambda a, b: (4 * a.bitwiseAND(3) + b.bitwiseAND(3)).isin(1, 6, 9)
    pairs = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows") - 1), lambda a, b: ~legal(a.cast("int"), b.cast("int")))
    inside = blocks.select("id", "at", F.size(F.filter(pairs, lambda x: x)).alias("inside"), F.element_at("rows", 1).cast("int").alias("head"), F.element_at("rows", -1).cast("int").alias("tail"))
    before = F.lag("tail").over(Window.partitionBy("id").orderBy("at"))
    seam = F.coalesce((~legal(before, F.col("head"))).cast("int"), F.lit(0))
    return inside.select("id", (F.col("inside") + seam).alias("n")).groupBy("id").agg(F.sum("n").alias("illegal"))


def repair(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of :func:`rows_in_order` with ``edit, inserts, assistant``, and one row more, with a null edit, for inserts at a conversation's end.

    ``edit`` is K, R or D; ``inserts`` counts the rows inserted before; ``assistant`` says that the first role that the inserts, or the row's new role, take is the
    assistant's; roles alternate from there. Copies of a row beyond the first are deleted after it. Keep costs 0, Rerole 1, Delete 2, Insert 5, and a row that
    stays cut off 5 more; blank rows and repeats must go. Of equal costs the string of edit letters that sorts first wins.
    """
    ends = blocks.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    several = ends.where("n > 1").select(F.struct("id").alias("who"))
    many = durable(blocks.withColumn("who", F.struct("id")).join(several, "who", "left_semi").drop("who"))
    marked = blocks.join(ends.select("at", F.lit(True).alias("last")), "at", "left").join(_many_blocks(many), "at", "left")
    accept = F.array(*[F.lit(int(v)).cast("long") for v in ACCEPT])
    ready = marked.select("id", "at", "rows", F.coalesce("last", F.lit(False)).alias("last"), F.coalesce("end", accept).alias("end"), F.coalesce("entry", F.lit(START)).alias("entry"))

    def tracing(batch: pa.RecordBatch):
        ends, entry = np.array(batch.column("end").to_pylist(), np.int64), batch.column("entry").to_numpy(zero_copy_only=False)
        last = batch.column("last").to_numpy(zero_copy_only=False).astype(bool)

        def work(rows: np.ndarray, index: np.ndarray) -> dict[str, np.ndarray]:
            return {"edits": edits(rows, costs_to_go(rows, ends[index]), entry[index], last[index])[0].T}

        return work

    solved = _pass(ready, "edits array<tinyint>", ["edits"], [pa.list_(pa.int8())], tracing)
    told = solved.select("at", F.size("edits").alias("n"), F.posexplode("edits").alias("i", "b")).select("at", "n", "i", F.col("b").cast("int").alias("e")).where("i < n - 1 or e & 12 != 0")
    letter = F.element_at(F.array(F.lit("D"), F.lit("K"), F.lit("R")), F.col("e").bitwiseAND(3) + 1)
    tail = F.col("i") == F.col("n") - 1
    told = told.select((F.col("at") + F.col("i") - tail.cast("int")).alias("at"), F.when(~tail, letter).alias("edit"), F.shiftright(F.col("e").bitwiseAND(12), 2).alias("inserts"), (F.col("e").bitwiseAND(16) != 0).alias("assistant"))
    return rows.join(told, "at")


def _role(assistant: Column, k: int | Column) -> Column:
    return F.when((assistant.cast("int") + k) % 2 == 1, "assistant").otherwise("user")


def repaired_turns(turns: DataFrame, repaired: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, at, sub, letter, role, text)``: every edit of :func:`repair` in the order of ``at, sub``; role and text are null where a row goes.

    ``turns`` are the rows that were repaired; texts are joined back by turn, role and digest. The deletion of further copies is one row whose letter repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    me = F.struct(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"))
    texts = turns.select(me.alias("me"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    asked = repaired.where("edit in ('K', 'R')").select(F.struct("id", "turn").alias("me"), "role", "digest", "at", "edit", "inserts", "assistant")
    said = asked.join(texts.dropDuplicates(["me", "role", "digest"]), ["me", "role", "digest"])
    role = F.when(F.col("edit") == "R", _role(F.col("assistant"), F.col("inserts"))).otherwise(F.col("role"))
    kept = said.select("me.id", "at", F.lit(2).alias("sub"), F.col("edit").alias("letter"), role.alias("role"), "text")
    added = repaired.where("inserts > 0").select("id", "at", "edit", "assistant", F.explode(F.sequence(F.lit(0), F.col("inserts") - 1)).alias("k"))
    added = added.select("id", "at", (F.col("k") + F.when(F.col("edit").isNull(), 4).otherwise(0)).alias("sub"), F.lit("I").alias("letter"), _role(F.col("assistant"), F.col("k")).alias("role"), F.lit("").alias("text"))
    gone = F.col("copies") - F.when(F.col("edit") == "D", 0).otherwise(1)
    gone = repaired.where(F.col("edit").isNotNull() & (gone > 0)).select("id", "at", F.lit(3).alias("sub"), F.repeat(F.lit("D"), gone.cast("int")).alias("letter"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return kept.unionByName(added).unionByName(gone)


def digests(edited: DataFrame) -> DataFrame:
    """``(id, audit, repaired_sha256)`` from :func:`repaired_turns`: edit letters in order, and the SHA-256 of ``role:text`` lines joined by line breaks.

    A hash over one conversation is read in order by one task, a row at a time; no conversation is held.
    """
    bounded_batches(edited.sparkSession)
    id_type = edited.schema["id"].dataType.simpleString()
    ordered = edited.repartition("id").sortWithinPartitions("id", "at", "sub").select("id", "letter", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, letters, told, lines, out = None, None, None, 0, []

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_arrow), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["id", "audit", "repaired_sha256"])

        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for who, letter, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if letters is None or who != open_id:
                    if letters is not None:
                        out.append((open_id, "".join(letters), told.hexdigest()))
                    open_id, letters, told, lines = who, [], hashlib.sha256(), 0
                letters.append(letter)
                if line is not None:
                    told.update(b"\n" * (lines > 0) + line.encode("utf-8"))
                    lines += 1
            yield ready()
            out.clear()
        if letters is not None:
            out.append((open_id, "".join(letters), told.hexdigest()))
            yield ready()

    return ordered.mapInArrow(run, f"id {id_type}, audit string, repaired_sha256 string")


def counts(repaired: DataFrame) -> DataFrame:
    """``(id, gaps, blank, duplicate, truncated, cost, further)`` of :func:`repair`: turns missing between the first and the last, rows by their first fault, the price of all edits, and copies beyond the first."""
    row, further = F.col("edit").isNotNull(), F.col("copies") - 1
    price = F.col("inserts") * INSERT + F.when(row, F.when(F.col("edit") == "D", DELETE).otherwise(F.when(F.col("edit") == "R", REROLE).otherwise(KEEP) + F.when(F.col("cut_off"), UNFINISHED).otherwise(0)) + DELETE * further).otherwise(0)
    count = lambda of, n: F.sum(F.when(row & of, n).otherwise(0)).cast("long")
    return repaired.groupBy("id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count(F.col("blank"), F.col("copies")).alias("blank"),
        count(~F.col("blank"), F.col("copies") - F.col("first").cast("int")).alias("duplicate"),
        count(~F.col("blank") & F.col("first") & F.col("cut_off"), F.lit(1)).alias("truncated"),
        F.sum(price).cast("long").alias("cost"),
        count(F.lit(True), further).alias("further"),
    )
