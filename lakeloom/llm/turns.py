"""Repair of the turn structure of conversations at the least cost.

A conversation is well formed if it is empty, or if its roles are an optional system turn and then pairs
of user and assistant: ``(s?(ua)+)?`` in initials. Rows may be kept (K), given the role user or assistant
(R, cost 1), deleted (D, cost 2; the only way for blank rows and for later copies of a row), and turns without text may be inserted
anywhere (I, cost 5). A truncated row that stays costs 5 more.

*Layers.* The grammar's four states (start, after s, after u, after a) are four bits. For each row, a word holds one
such set of states for each cost, as in Wu and Manber's matching with errors: bit 4 c + s says that from state s
the rest of the conversation can be accepted at cost c. The word before a row follows from the one after it by shifts:
by two layers for a deletion, one for a new role, five for an insertion or a truncated row. What precedes the least layer is
shifted out and counted; 13 layers are enough, since an insertion or two lead from any state to one that is as good or better, so that
states more than 12 above the least are on no cheapest path. Before the first row, the first layer that has the
start state is the cost; from there the bits are followed forward, each time along the first letter (D, I, K, R) whose target lies on
a cheapest path, which gives the least sequence of letters among all cheapest ones.

*Long conversations.* Rows are sorted by range over many tasks and cut into segments of at most ``1 << SEGMENT_BITS`` rows, so a
conversation may span any number of them. Of a conversation that does, each segment is summed up by the costs from each state to
each state, which are the layers run once for each state at its end; these are composed from the last segment to the first (one small row for
a segment), the bits are traced from all four states, and the state that the conversation
really enters a segment with picks its trace. Repeated rows are counted, not listed, before rows are sorted.

Defined results: nulls in role and text count as one space; a null conv_id is a conversation of its own; null turns come first; rows of
one turn are in order of role, then text; extra columns are ignored; texts may have any length; an empty table gives no
rows. ``digest`` streams one conversation's texts through one task, in bounded memory but for the audit, since SHA-256 over them has no other order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import WORD_REGEX, Scratch

SEGMENT_BITS = 17
START, SYSTEM, USER, ASSISTANT = range(4)
LAYERS = 13
MASK = (1 << 4 * LAYERS) - 1
EACH = sum(1 << 4 * c for c in range(LAYERS + 12))
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: of a row's kind: the initial's code in the low two bits (0: another), then these
MUST_GO, TRUNCATED = 4, 8


def _via_user(word: int) -> int:
    at = word & (EACH << USER)
    return (at >> 2) | (at >> 1) | (at << 1)


def _via_assistant(word: int) -> int:
    return (word & (EACH << ASSISTANT)) >> 1


def with_insertions(word: int) -> int:
    """States that reach the word's by up to two insertions."""
    for _ in range(2):
        word |= (_via_user(word) | _via_assistant(word)) << 4 * INSERT
    return word


def step_back(word: int, kind: int) -> int:
    """The word before a row from the word after it, not yet shifted down."""
    out = word << 4 * DELETE
    if not kind & MUST_GO:
        user, assistant, initial = _via_user(word), _via_assistant(word), kind & 3
        kept = user if initial == USER else assistant if initial == ASSISTANT else (word & (EACH << SYSTEM)) >> 1 if initial == SYSTEM else 0
        out |= (kept | (user | assistant) << 4 * RENAME) << (4 * CUT_OFF if kind & TRUNCATED else 0)
    return with_insertions(out)


def layers(kinds: list[int], word: int) -> tuple[list[int], list[int]]:
    """Words before each row and after the last, and the costs that were shifted out of each."""
    words, gone, total = [word], [0], 0
    for kind in reversed(kinds):
        word = step_back(word, kind)
        down = ((word & -word).bit_length() - 1) // 4
        word = (word >> 4 * down) & MASK
        total += down
        words.append(word)
        gone.append(total)
    return words[::-1], gone[::-1]


def least(word: int, state: int) -> int | None:
    """The first layer that has a state."""
    at = (word >> state) & EACH
    return ((at & -at).bit_length() - 1) // 4 if at else None


ACCEPT = with_insertions(1 << START | 1 << ASSISTANT)


def word_of(costs) -> int:
    """A word from the cost of each state (negative: none), without what is above the last layer."""
    return sum(1 << (4 * c + s) for s, c in enumerate(costs) if 0 <= c < LAYERS)


def trace(kinds: list[int], words: list[int], gone: list[int], state: int, last: bool) -> tuple[list[str], int]:
    """For each row its edit, K, R (to user), Q (to assistant) or D, with inserted roles u and a around it; the state at the end.

    last: the conversation ends here, so that missing turns are inserted after the last row."""
    edits = []
    for i, kind in enumerate(kinds):
        edit = ""
        while True:
            here = gone[i] + least(words[i], state)
            cost_after = lambda s, i=i: gone[i + 1] + c if (c := least(words[i + 1], s)) is not None else 1 << 62
            if cost_after(state) + DELETE == here:
                edit += "D"
                break
            follow = ASSISTANT if state == USER else USER
            then = least(words[i], follow)
            if then is not None and gone[i] + then + INSERT == here:
                edit += "a" if state == USER else "u"
                state = follow
                continue
            extra, initial = CUT_OFF if kind & TRUNCATED else 0, kind & 3
            kept = initial if initial == follow or (initial == SYSTEM and state == START) else None
            if kept is not None and cost_after(kept) + extra == here:
                edit, state = edit + "K", kept
            else:
                edit, state = edit + ("Q" if state == USER else "R"), follow
            break
        edits.append(edit)
    while last and state not in (START, ASSISTANT):
        edits[-1] += "a" if state == USER else "u"
        state = ASSISTANT if state == USER else USER
    return edits, state


def _parts(table):
    """(first row, end) of each conversation of a segment's rows, which are in order."""
    import numpy as np
    import pyarrow as pa

    ids = table.column("conv_id").combine_chunks()
    codes = np.asarray((ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).dictionary_encode(null_encoding="encode").indices)
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _sum_up(table):
    """A segment of one conversation: the cost from each state before it to each state after it, in rows of four."""
    import pyarrow as pa

    kinds, costs = table.sort_by("number").column("kind").to_pylist(), [[-1] * 4 for _ in range(4)]
    for end in range(4):
        words, gone = layers(kinds, 1 << end)
        for state in range(4):
            if (c := least(words[0], state)) is not None:
                costs[state][end] = gone[0] + c
    return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "segment": table.column("segment").slice(0, 1), "costs": pa.array([sum(costs, [])], pa.list_(pa.int64()))})


def _link(table):
    """For the segments of one conversation: the cost to the conversation's end from each state at the segment's end, above their least."""
    import pyarrow as pa

    table = table.sort_by([("segment", "descending")])
    now, ends = [c if (c := least(ACCEPT, s)) is not None else -1 for s in range(4)], []
    for costs in table.column("costs").to_pylist():
        ends.append(now)
        sums = [[costs[4 * s + t] + now[t] for t in range(4) if costs[4 * s + t] >= 0 and now[t] >= 0] for s in range(4)]
        low = min(min(x) for x in sums if x)
        now = [min(x) - low if x else -1 for x in sums]
    ends = [[c - min(y for y in e if y >= 0) if c >= 0 else -1 for c in e] for e in ends]
    return pa.table({"conv_id": table.column("conv_id"), "segment": table.column("segment"), "ends": pa.array(ends, pa.list_(pa.int64())), "closes": pa.array([True] + [False] * (len(ends) - 1))})


def _trace_segment(table):
    """The edits of each row of a segment, for one entering state or for all four; on a conversation's last row the states it leaves with."""
    import pyarrow as pa

    table = table.sort_by("number")
    kinds, options, exits = table.column("kind").to_pylist(), [], []
    ends, closes = table.column("ends").to_pylist(), table.column("closes").to_pylist()
    for a, b in _parts(table):
        whole, last = ends[a] is None, ends[a] is None or closes[a]
        words, gone = layers(kinds[a:b], ACCEPT if last else word_of(ends[a]))
        traced = [trace(kinds[a:b], words, gone, s, last) if least(words[0], s) is not None else ([""] * (b - a), -1) for s in range(1 if whole else 4)]
        options += [list(x) for x in zip(*(edits for edits, _ in traced), strict=True)]
        exits += [None] * (b - a - 1) + [None if whole else [x for _, x in traced]]
    return pa.table({"number": table.column("number"), "conv_id": table.column("conv_id"), "segment": table.column("segment"), "options": pa.array(options, pa.list_(pa.string())), "exits": pa.array(exits, pa.list_(pa.int64()))})


def _enter(table):
    """The state with which one conversation enters each of its segments."""
    import pyarrow as pa

    table, state, states = table.sort_by("segment"), START, []
    for exits in table.column("exits").to_pylist():
        states.append(state)
        state = exits[state]
    return pa.table({"conv_id": table.column("conv_id"), "segment": table.column("segment"), "state": pa.array(states, pa.int32())})


def _sorted_rows(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, number, segment, turn, role, text, copies, fault, kind: each distinct row, numbered in order."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    counted = scratch.save(counted.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "counted")
    # a row repeated in other turns: all but the first one are duplicates
    said = counted.groupBy("conv_id", "said").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn").alias("turn"))).alias("first")).filter("n > 1")
    said = said.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    both = counted.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD_REGEX), "blank").when(later, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    kind = code + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    dealt = both.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")).withColumn("kind", kind.cast("int"))
    order = ("conv_id", "turn", "role", "text")
    ordered = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.save(ordered.withColumn("number", F.monotonically_increasing_id()).withColumn("segment", F.shiftright("number", SEGMENT_BITS)), "ordered")


def repair_conversations(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, number (ascending in a conversation), turn, role, text, copies, fault, edit for each distinct row.

    edit: K, R (new role user), Q (new role assistant) or D, for the first copy (the others go), with inserted roles u and a before and after it."""
    ordered = _sorted_rows(spark, rows, scratch)
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    codes = ordered.select("conv_id", "number", "segment", "kind")
    spread = scratch.save(codes.groupBy("conv_id").agg(F.min("segment").alias("lo"), F.max("segment").alias("hi")).filter("lo < hi").select(F.col("conv_id").alias("c")), "spread")
    parts = codes.join(spread, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    sums = parts.groupBy("conv_id", "segment").applyInArrow(_sum_up, f"conv_id {id_type}, segment long, costs array<long>")
    ends = scratch.save(sums.groupBy("conv_id").applyInArrow(_link, f"conv_id {id_type}, segment long, ends array<long>, closes boolean"), "ends")
    ends = ends.withColumnsRenamed({"conv_id": "c", "segment": "g"})
    traced = codes.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("g")), "left").drop("c", "g")
    traced = scratch.save(traced.groupBy("segment").applyInArrow(_trace_segment, f"number long, conv_id {id_type}, segment long, options array<string>, exits array<long>"), "traced")
    states = traced.filter("exits is not null").groupBy("conv_id").applyInArrow(_enter, f"conv_id {id_type}, segment long, state int")
    states = states.withColumnsRenamed({"conv_id": "c", "segment": "g"})
    chosen = traced.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("g")), "left")
    chosen = chosen.select(F.col("number").alias("n"), F.element_at("options", F.coalesce("state", F.lit(START)) + 1).alias("edit"))
    return ordered.join(chosen, F.col("number") == F.col("n")).select("conv_id", "number", "turn", "role", "text", "copies", "fault", "edit")


def repaired_rows(edits: DataFrame) -> DataFrame:
    """conv_id, number, place, role, text of the repaired conversations, in order of number and place; text is null where a turn was inserted."""
    each = edits.withColumn("letters", F.filter(F.split("edit", ""), lambda x: ~x.isin("", "D"))).select("*", F.posexplode("letters").alias("place", "letter"))
    inserted = F.col("letter").isin("u", "a")
    role = F.when(F.col("letter").isin("u", "R"), "user").when(F.col("letter").isin("a", "Q"), "assistant").otherwise(F.col("role"))
    return each.select("conv_id", "number", "place", role.alias("role"), F.when(~inserted, F.col("text")).alias("text"))


def digest(edits: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, faulty rows, role changes that are illegal, the cost, the audit and a digest of the repaired turns."""
    id_type = edits.schema["conv_id"].dataType.simpleString()
    slim = edits.select("conv_id", "number", F.col("turn").cast("long").alias("turn"), "role", F.when(F.col("edit").rlike("[KRQ]"), F.col("text")).alias("text"), "copies", "fault", "edit")
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return ordered.mapInArrow(_digest, f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


LEGAL = ("su", "ua", "au")


class _Sum:
    """One conversation as its rows stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.low, self.high, self.turns, self.turn, self.before = conv_id, None, None, 0, None, None
        self.faults, self.illegal, self.cost, self.audit, self.sha, self.any = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, [], hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
        self.any = True

    def add(self, turn, role, text, copies, fault, edit) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        initial = role[:1]
        self.illegal += copies - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before = initial
        self.faults["duplicate"] += (copies - 1) * (fault != "blank")
        if fault:
            self.faults[fault] += copies if fault == "blank" else 1
        for letter in edit:
            if letter in ROLES:
                self.say(ROLES[letter], "")
                self.cost += INSERT
            elif letter == "D":
                self.cost += DELETE
            else:
                self.say(role if letter == "K" else "user" if letter == "R" else "assistant", text)
                self.cost += (letter != "K") * RENAME + (fault == "truncated") * CUT_OFF
            self.audit.append("I" if letter in ROLES else "R" if letter == "Q" else letter)
            if letter not in ROLES:
                self.audit.append("D" * (copies - 1))
        self.cost += DELETE * (copies - 1)

    def row(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digest(batches):
    import pyarrow as pa

    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    now, done, id_type = None, [], None

    def out():
        columns = [pa.array([r[0] for r in done], id_type)] + [pa.array([r[i + 1] for r in done], pa.string() if i > 5 else pa.int64()) for i in range(len(names))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault", "edit")]
        for conv_id, *rest in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Sum(conv_id)
            now.add(*rest)
        if len(done) > 10_000:
            yield out()
    if now is not None:
        done.append(now.row())
        yield out()


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by the CRC-32 of conv_id:turn modulo 20 (nulls: one space), and the condition on the original rows that one is dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), code.alias("code"), times.alias("times"))
    return rows.filter("code <> 0").select("conv_id", "turn", "role", "text", F.explode("times").alias("time")).drop("time"), code == 0
