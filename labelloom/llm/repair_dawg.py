"""Conversation structure repair with a suffix-shared automaton.

Each turn is one symbol: its role's initial and its fault.  A conversation's
signature is its string of symbols, and signatures that end alike share the
nodes of that end: a node is a symbol and the node of the rest.  Reading the
distinct signatures from their ends, in order, meets all that share a node one
after the other, so its cost-to-go and best next edit for each state of the
role grammar are worked out once, whichever conversations pass through it.
(Only where Spark cuts the order into ranges, the shared ends of the two
signatures at the cut are worked out on both sides.)

Of equally cheap edits the one with the least letter is taken.  The edits that
are possible in a state have different letters, so this is the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import materialize

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # what edits cost, and a truncated turn that stays
#: The grammar (s?(ua)+)? of role initials: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that an edit may give a turn in each state; no edit gives "system".
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: Symbols: s, u, a or x (any other initial), upper-case if truncated, or a turn that must go.
GONE = "-"
#: At the end of a conversation: cost-to-go and next edit by state ("" is to stop).
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))

REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@lru_cache(maxsize=1 << 16)
def _node(symbol: str, rest: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost-to-go and next edit by state, of a symbol before a node with the costs ``rest``."""
    best = []
    for state in range(4):
        options = [(DELETE + rest[state], "D")]
        if symbol != GONE:
            stays = TRUNCATED if symbol.isupper() else 0
            kept = NEXT.get((state, symbol.lower()))
            if kept is not None:
                options.append((stays + rest[kept], "K"))
            options.append((REROLE + stays + rest[NEXT[state, GIVEN[state][0]]], "R"))
        best.append(min(options))
    # Two inserted turns lead from any state to any that inserts can reach.
    for _ in range(2):
        best = [min(best[s], (INSERT + best[NEXT[s, GIVEN[s][0]]][0], "I")) for s in range(4)]
    return tuple(c for c, _ in best), tuple(e for _, e in best)


def node(symbol: str, rest: tuple[tuple[int, ...], tuple[str, ...]]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """The node of ``symbol`` before the node ``rest``."""
    # Only differences matter, and they are few: the same step is not worked out twice.
    least = min(rest[0])
    costs, edits = _node(symbol, tuple(c - least for c in rest[0]))
    return tuple(c + least for c in costs), edits


class Automaton:
    """The nodes of the last signature, from its end; the next signature keeps those that it shares."""

    def __init__(self):
        self.nodes, self.last = [END], ""

    def audit(self, backward: str) -> tuple[int, str]:
        """(cost, audit) of a signature given from its end."""
        same = 0
        for x, y in zip(self.last, backward):
            if x != y:
                break
            same += 1
        del self.nodes[same + 1:]
        for symbol in backward[same:]:
            self.nodes.append(node(symbol, self.nodes[-1]))
        self.last = backward
        state, left, audit = START, len(backward), []
        while edit := self.nodes[left][1][state]:
            audit.append(edit)
            if edit != "D":
                state = NEXT[state, backward[left - 1].lower() if edit == "K" else GIVEN[state][0]]
            left -= edit != "I"
        return self.nodes[-1][0][START], "".join(audit)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        backward = batch.column(0).to_pylist()
        found = [automaton.audit(s) for s in backward]
        yield pa.RecordBatch.from_arrays([
            pa.array([s[::-1] for s in backward], pa.string()), pa.array([c for c, _ in found], pa.int64()),
            pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def audit_table(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct values of the column ``signature``."""
    backward = materialize(signatures.select(F.reverse("signature").alias("backward")).distinct(), "repair-signatures")
    return backward.repartitionByRange("backward").sortWithinPartitions("backward").mapInArrow(
        _audit, "signature string, cost long, audit string")


def _marked(talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The turns with their place, symbol and faults."""
    rows = talks.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n)
                          for c, n in ((role_col, "role"), (text_col, "text"))))
    initial, trimmed = F.substring("role", 1, 1), F.rtrim("text", F.lit(BLANKS))
    # One shuffle: both windows are within conversations.
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = (rows.withColumn("pos", F.row_number().over(order).cast("long"))
            .withColumn("before", F.lag(initial).over(order)).withColumn("turn_before", F.lag("turn").over(order)))
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("pos")) > 1
    fault = (F.when(trimmed == "", "blank").when(again, "duplicate")
             .when(~F.substring(trimmed, -1, 1).isin(*ENDS), "truncated"))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(letter))
              .otherwise(letter))
    return rows.withColumn("fault", fault).select(
        "conv", "pos", "turn", "role", "text", "fault", symbol.alias("symbol"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
        ((F.col("pos") > 1) & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"))


def _count(condition: str) -> Column:
    return F.count_if(F.expr(condition))


def plan_repair(talks: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What ``repaired_turns`` and ``repair_report`` read: turns behind their conversation's row, in order.

    ``ids`` has ids of further conversations that are reported even without turns.

    A null role or text counts as one space, and texts without other characters
    than blanks are blank.  Turns without number come first; turns of one number
    are ordered by role, then text.  A null conversation id makes one
    conversation.  Roles that don't begin with s, u or a (empty ones, too) can't
    be kept.  Other columns are ignored; an empty table gives an empty result.
    Of a conversation one task holds the symbols, a few bytes a turn, never the
    texts together.
    """
    marked = materialize(_marked(talks, conv_col, turn_col, role_col, text_col), "repair-turns")
    signature = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
    spread = F.max("turn") - F.min("turn") + 1 - _count("new_turn")
    found = marked.groupBy("conv").agg(
        F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), _count("fault = 'blank'").alias("blank"),
        _count("fault = 'duplicate'").alias("duplicate"), _count("fault = 'truncated'").alias("truncated"),
        _count("illegal").alias("illegal"), signature.alias("signature"))
    found = materialize(found, "repair-conversations")
    best = materialize(audit_table(found), "repair-audits")
    heads = found.join(best, "signature").select("conv", *REPORT, "audit")
    if ids is not None:
        without = ids.select(F.col(ids.columns[0]).alias("conv")).distinct().join(
            found.select(F.col("conv").alias("with_turns")), F.col("conv").eqNullSafe(F.col("with_turns")), "left_anti")
        heads = heads.union(without.select("conv", *(F.lit(0).cast("long") for _ in REPORT), F.lit("")))
    both = heads.withColumn("pos", F.lit(0).cast("long")).unionByName(
        marked.select("conv", "pos", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "pos")


class _Conversation:
    """Applies an audit to the turns of a conversation as they come."""

    def __init__(self, head: dict):
        self.head, self.at, self.state, self.made = head, 0, START, 0

    def _give(self, role: str) -> None:
        self.state, self.made, self.at = NEXT[self.state, role[:1]], self.made + 1, self.at + 1

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """The turns inserted before the next one."""
        while self.head["audit"][self.at:self.at + 1] == "I":
            role = GIVEN[self.state]
            self._give(role)
            yield "I", role, ""

    def taken(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.head["audit"][self.at]
        if edit == "D":
            self.at += 1
            return
        role = role if edit == "K" else GIVEN[self.state]
        self._give(role)
        yield edit, role, text


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple[str, str, str] | None]]:
    """(conversation, (edit, role, text)) of each repaired turn; without turn when it is complete."""
    current = None
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        heads = {n: columns[n].to_pylist() for n in ("conv", *REPORT, "audit")}
        for i, (pos, role, text) in enumerate(zip(*(columns[n].to_pylist() for n in ("pos", "role", "text")))):
            if pos:
                yield from ((current, turn) for turn in current.taken(role, text))
                continue
            if current:
                yield from ((current, turn) for turn in current.inserted())
                yield current, None
            current = _Conversation({n: v[i] for n, v in heads.items()})
    if current:
        yield from ((current, turn) for turn in current.inserted())
        yield current, None


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(plan: DataFrame, fields: str, rows) -> DataFrame:
    """``rows`` of the edited turns, with the conversation's id in front of ``fields``."""
    schema = T.StructType([T.StructField("conv_id", plan.schema["conv"].dataType), *T.StructType.fromDDL(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = {"string": pa.string(), "long": pa.int64()}
        arrow = pa.schema([("conv_id", first.schema.field("conv").type)]
                          + [(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches
        yield from _batches(rows(_edited(again())), arrow)
    return plan.mapInArrow(run, schema)


def repaired_turns(plan: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns after the repair, counted from 1."""
    def rows(edited) -> Iterator[dict]:
        for talk, turn in edited:
            if turn:
                yield {"conv_id": talk.head["conv"], "position": talk.made, "edit": turn[0], "role": turn[1], "text": turn[2]}
    return _mapped(plan, "position long, edit string, role string, text string", rows)


def repair_report(plan: DataFrame) -> DataFrame:
    """A row per conversation: gaps, faults, cost and audit, and the digest of the repaired turns.

    ``repaired_sha256`` is that of ``role:text`` of the repaired turns, joined
    by newlines.  It grows with each turn, so the texts are never held together.
    """
    def rows(edited) -> Iterator[dict]:
        digest, turns = hashlib.sha256(), 0
        for talk, turn in edited:
            if turn:
                digest.update((("\n" if turns else "") + f"{turn[1]}:{turn[2]}").encode())
                turns += 1
                continue
            yield {**{n: talk.head[n] for n in (*REPORT, "audit")}, "conv_id": talk.head["conv"], "turns": turns,
                   "repaired_sha256": digest.hexdigest()}
            digest, turns = hashlib.sha256(), 0
    counts = ", ".join(f"{n} long" for n in REPORT)
    return _mapped(plan, f"{counts}, audit string, turns long, repaired_sha256 string", rows)


def damage(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with planted faults: a test set for the repair.

    The crc32 of ``conv:turn`` modulo 20 decides: 0 drops the turn, 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats
    it, 4 gives it the role "user".  A null counts as one space.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = talks.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"),
        (F.crc32(F.encode(F.concat(text(conv_col), F.lit(":"), text(turn_col)), "UTF-8")) % 20).alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("kind <> 0").withColumn("copy", copies).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"))
