"""Conversation structure repair: fewest edits after which roles alternate.

A conversation is read in the order of its turns and edited until its roles are
nothing, or an optional system row and then pairs of user and assistant. Rows are
dealt out by conversation and sorted by turn; one pass over the sorted rows
carries the state of a shortest-path search from batch to batch. The state is a
cost, a rank and a running hash for each of four places in the pattern, whatever
the length of the conversation. What grows is one byte a row and place that says
how the best path came there; beyond SPILL_BYTES those bytes go to an unnamed
file of the task.

Every list of edits that leads to one place after the same number of rows ends with an edit of the
last of them, so no list is the beginning of another. The order of two lists is
then the order after any common continuation, and ranks of the places are enough
to find the least list in the end.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.llm.common import bounded_batches, pick

# Fixed values of the contract: costs of edits, and the faults of rows.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACES = " \t\n\x0b\x0c\r"

SPILL_BYTES = 4 << 20

# Places in the pattern: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
WANTED = ["user", "user", "assistant", "user"]  # the role to insert, or to change to, at each place
ENDING = ["", "II", "I", ""]  # inserts that make a place a valid end
ROLE = {"s": "system", "u": "user", "a": "assistant"}


class Move(NamedTuple):
    before: int
    after: int
    edits: str  # an insert at most, then the edit of the row
    cost: int


def moves(initial: str, fault: int) -> list[Move]:
    """All moves over a row that can be best, those from one place in the order of their edits.

    A second insert before a row only leads round to a place from where the same
    edits go on. An insert before a deleted row can as well follow it, which is
    the lesser list.
    """
    out = []
    for before in range(4):
        out.append(Move(before, before, "D", COSTS["D"]))
        if fault in (BLANK, DUPLICATE):
            continue
        for inserts in ("", "I"):
            place = NEXT[before, WANTED[before][0]] if inserts else before
            for edit, letter in (("K", initial), ("R", WANTED[place][0])):
                if (place, letter) in NEXT:
                    cost = len(inserts) * COSTS["I"] + COSTS[edit] + TRUNCATED_COST * (fault == TRUNCATED)
                    out.append(Move(before, NEXT[place, letter], inserts + edit, cost))
    return sorted(out, key=lambda m: (m.before, m.edits))


MOVES = {(letter, fault): moves(letter, fault) for letter in ("s", "u", "a", "") for fault in range(4)}
EDITS = sorted({m.edits for ms in MOVES.values() for m in ms})


class Trail:
    """How the best path came to each place after each row: four bytes a row, in blocks that may lie in a file."""

    def __init__(self, spill_bytes: int):
        self.limit, self.block, self.file, self.rows = spill_bytes, bytearray(), None, 0

    def add(self, steps: bytes) -> None:
        self.block += steps
        self.rows += 1
        if len(self.block) >= self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.block)
            self.block.clear()

    def back(self) -> Iterator[bytes]:
        """The blocks from the last to the first."""
        yield bytes(self.block)
        at = self.file.tell() if self.file else 0
        while at > 0:
            size = min(at, 4 * max(1, self.limit // 4))
            at -= size
            self.file.seek(at)
            yield self.file.read(size)

    def edits(self, place: int) -> str:
        """The list of edits that ends at a place."""
        pieces = []
        for block in self.back():
            own = []
            for i in range(len(block) - 4, -1, -4):
                step = block[i + place]
                own.append(EDITS[step >> 2])
                place = step & 3
            pieces.append("".join(reversed(own)))
        if self.file:
            self.file.close()
        return "".join(reversed(pieces))


class Path:
    """The search over one conversation, row by row."""

    def __init__(self, spill_bytes: int = SPILL_BYTES):
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.text: list = [hashlib.sha256(), None, None, None]  # of what is written so far on the best path to a place
        self.trail = Trail(spill_bytes)
        self.counts = [0, 0, 0, 0]
        self.illegal = 0
        self.last: str | None = None
        self.least = self.most = None
        self.turns = 0

    def row(self, role: str, text: str, fault: int, turn: int | None) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        best: list = [None] * 4
        for m in MOVES[initial if initial in ROLE else "", fault]:
            before = self.cost[m.before]
            if before is not None:
                found = (before + m.cost, self.rank[m.before], m.edits)
                if best[m.after] is None or found < best[m.after][:3]:
                    best[m.after] = (*found, m)
        steps, texts, written = bytearray(4), [None] * 4, None
        for place, b in enumerate(best):
            if b is None:
                continue
            m = b[3]
            steps[place] = EDITS.index(m.edits) << 2 | m.before
            h = self.text[m.before]
            if m.edits[-1] != "D":
                h, at = h.copy(), m.before
                if m.edits[0] == "I":
                    h.update(self._line(WANTED[at], b"", at))
                    at = NEXT[at, WANTED[at][0]]
                written = text.encode("utf-8", "surrogatepass") if written is None else written
                h.update(self._line(role if m.edits[-1] == "K" else WANTED[at], written, at))
            texts[place] = h
        order = sorted((p for p in range(4) if best[p]), key=lambda p: (best[p][1], best[p][2]))
        for r, place in enumerate(order):
            self.rank[place] = r
        self.cost = [b and b[0] for b in best]
        self.text = texts
        self.trail.add(steps)

    @staticmethod
    def _line(role: str, text: bytes, place: int) -> bytes:
        return (b"" if place == NOTHING else b"\n") + role.encode("utf-8", "surrogatepass") + b":" + text

    def result(self) -> dict:
        ends = [(c + COSTS["I"] * len(ENDING[p]), self.rank[p], p) for p, c in enumerate(self.cost) if c is not None]
        cost, _, place = min(ends)
        edits, h = self.trail.edits(place), self.text[place]
        for _ in ENDING[place]:
            h.update(self._line(WANTED[place], b"", place))
            place = NEXT[place, WANTED[place][0]]
        return {
            "gaps": 0 if self.least is None else self.most - self.least + 1 - self.turns,
            "blank": self.counts[BLANK],
            "duplicate": self.counts[DUPLICATE],
            "truncated": self.counts[TRUNCATED],
            "illegal": self.illegal,
            "cost": cost,
            "audit": edits + ENDING[min(ends)[2]],
            "repaired_sha256": h.hexdigest(),
        }


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIELDS = [c.split()[0] for c in REPORT.split(", ")]


def ordered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None = None) -> DataFrame:
    """Rows dealt out by conversation and sorted by turn, with the fault of each.

    Null roles and texts become one space. Rows of one turn are ordered by role
    and text. ``there`` marks the rows that count; others only keep their
    conversation in the result. Faults are found in Spark: a row is a duplicate if
    it is not the first of its conversation, role and text. Those groups lie
    within the partitions by conversation, so this costs a sort and no exchange.
    """
    from pyspark.sql.window import Window

    rows = pick(
        conversations.withColumn("_there", F.lit(True) if there is None else there),
        conv=conv_col, turn=turn_col, role=F.coalesce(F.col(role_col), F.lit(" ")), text=F.coalesce(F.col(text_col), F.lit(" ")), there="_there",
    )
    rows = rows.withColumn("text", F.when(F.col("there"), F.col("text")).otherwise(""))
    dealt = rows.withColumn("digest", F.sha2("text", 256)).repartition("conv")
    seen = Window.partitionBy("conv", "there", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("copy") > 1, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    judged = dealt.withColumn("copy", F.row_number().over(seen)).withColumn("fault", fault.cast("int"))
    return judged.sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("there"), F.col("turn").asc_nulls_first(), "role", "text", "copy"
    )


def _paths(spill_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, path, done = None, None, []
        for batch in batches:
            columns = [batch[c].tolist() for c in ("conv", "known", "turn", "timed", "there", "role", "text", "fault")]
            for conv, known, turn, timed, there, role, text, fault in zip(*columns):
                if path is None or (conv, known) != key:
                    if path is not None:
                        done.append((key, path.result()))
                    key, path = (conv, known), Path(spill_bytes)
                if there:
                    path.row(role, text, fault, turn if timed else None)
            if done:
                yield table(done)
                done = []
        if path is not None:
            yield table([(key, path.result())])

    def table(done: list) -> pd.DataFrame:
        out = pd.DataFrame([report for _, report in done], columns=FIELDS)
        out.insert(0, "conv", pd.Series([conv if known else None for (conv, known), _ in done], dtype=object))
        return out

    return run


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    there: Column | None = None, spill_bytes: int = SPILL_BYTES,
) -> DataFrame:
    """One row per conversation: conv_id and the columns of REPORT.

    A null conversation id is a conversation of its own, a null turn comes first
    and leaves no gap, a null role or text is one space. An empty role has no
    initial and cannot be kept. Repeated rows are duplicates. A conversation without
    rows that count has zeros and no edits. An empty table gives an empty result.
    Turns are integers.
    """
    bounded_batches(conversations.sparkSession)
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = ordered(conversations, conv_col, turn_col, role_col, text_col, there)
    # pandas would turn integers with nulls into floats
    sent = rows.select(
        F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"), F.col("conv").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("timed"),
        "there", "role", "text", "fault",
    )
    out = sent.mapInPandas(_paths(spill_bytes), f"conv string, {REPORT}")
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *FIELDS)


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place, role, text, edit (K, R or I).

    ``place`` counts from 0 within a conversation. Edits of the report are paired with rows by their number.
    """
    from pyspark.sql.window import Window

    plan = repair(conversations, conv_col, turn_col, role_col, text_col, there)
    in_order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    rows = ordered(conversations, conv_col, turn_col, role_col, text_col, there).where("there")
    numbered = rows.select("conv", "role", "text", F.row_number().over(in_order).alias("number"))
    # an edit's row is the number of edits of rows up to it, its place the number of edits that leave a row before it
    each = plan.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit != ''")
    so_far = Window.partitionBy("conv_id").orderBy("at")
    counted = each.select(
        "conv_id", "edit",
        F.sum(F.when(F.col("edit") == "I", 0).otherwise(1)).over(so_far).alias("number"),
        (F.sum(F.when(F.col("edit") == "D", 0).otherwise(1)).over(so_far) - 1).alias("place"),
    ).where("edit != 'D'")
    both = counted.join(numbered, F.col("conv_id").eqNullSafe(F.col("conv")) & (counted.number == numbered.number) & (F.col("edit") != "I"), "left")
    first = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K"), F.col("role").startswith("s").cast("int")).otherwise(0)).over(Window.partitionBy("conv_id"))
    side = F.when((F.col("place") - first) % 2 == 0, "user").otherwise("assistant")
    return both.select(
        "conv_id", "place", F.when(F.col("edit") == "K", F.col("role")).otherwise(side).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conversation and turn; ``there`` is false for a row that is taken out.

    Of 20 remainders 0 takes the row out, 1 empties its text, 2 removes its full
    stops, 3 repeats it, and 4 makes its role user.
    """
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op13: all conversations, damaged and repaired."""
    rows = damaged(bounded_batches(spark).read.parquet(f"{folder}/conversations.parquet"))
    return repair(rows, there=F.col("there"))
