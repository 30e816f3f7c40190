"""Repair of the structure of conversations, by square-root checkpointed dynamic programming.

A well-formed conversation is an optional system row followed by user and assistant rows in
turn, ending with the assistant's: its role initials match ``(s?(ua)+)?``. The cheapest edits
that lead there are found backwards: the cost vector of a place holds, for each state of that
pattern, the least cost of what follows.

* Rows are put in order once and become one small code each; texts stay where they are.
* Codes are cut into blocks of ``BLOCK`` rows. A block's effect on cost vectors is a small
  matrix, its effect on states a small map; both are combined over the blocks of a long
  conversation in groups of ``FAN``, level by level. So each block learns the vector at its end
  and the state at its start without the others' rows.
* Inside a block only the vectors at about the square root of its rows are kept. The walk
  forward computes a stretch between two of them anew and takes, at each place, the
  ASCII-least edit among those that are as cheap as the vector says.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import staged
from mailsift.ranking import number_by_order

# Rows of a conversation that one task walks at once, and blocks whose effects are combined at once.
BLOCK, FAN = 4096, 1024
# Costs of the edits, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# States of the pattern: nothing yet, after s, after u, after a. Each has one role that may be
# inserted or assigned next.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# A row's code: its initial (0 other, 1 s, 2 u, 3 a) and two flags.
MUST_GO, CUT_OFF = 4, 8
KEEPS = {(NONE, 1): SYSTEM, (NONE, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}
LEGAL = {(1, 2), (2, 3), (3, 2)}
# Larger than any cost.
NEVER = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)

KEY = ["conv", "none"]

Vector = tuple[int, int, int, int]


def before_row(code: int, after: Vector) -> Vector:
    """The cost vector in front of a row, with insertions there, from the one behind it."""
    none, system, user, assistant = (v + DELETE for v in after)
    if not code & MUST_GO:
        extra = TRUNCATED if code & CUT_OFF else 0
        role = after[USER] + REROLE + extra
        none, system, assistant = min(none, role), min(system, role), min(assistant, role)
        user = min(user, after[ASSISTANT] + REROLE + extra)
        initial = code & 3
        if initial == 1:
            none = min(none, after[SYSTEM] + extra)
        elif initial == 2:
            kept = after[USER] + extra
            none, system, assistant = min(none, kept), min(system, kept), min(assistant, kept)
        elif initial == 3:
            user = min(user, after[ASSISTANT] + extra)
    user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
    return min(none, user + INSERT), min(system, user + INSERT), user, assistant


def _back(codes: list[int], end: Vector) -> Vector:
    for code in reversed(codes):
        end = before_row(code, end)
    return end


def walk(codes: list[int], end: Vector, state: int, last: bool) -> tuple[str, int, list[tuple]]:
    """(edits' initials, state behind them, changed rows) of a block, from the vector at its end.

    A changed row is (number, roles inserted before, role or None if deleted, roles inserted
    after). ``last`` says that the conversation ends with this block.
    """
    stretch = math.isqrt(len(codes)) + 1
    checkpoints = {len(codes): end}
    vector, borders = end, range((len(codes) - 1) // stretch * stretch, 0, -stretch)
    stop = len(codes)
    for border in borders:
        vector = checkpoints[border] = _back(codes[border:stop], vector)
        stop = border
    edits, changes = [], []
    for start in range(0, len(codes), stretch):
        stop = min(start + stretch, len(codes))
        vectors = [checkpoints[stop]]
        for code in reversed(codes[start:stop]):
            vectors.append(before_row(code, vectors[-1]))
        for i in range(start, stop):
            here, after, code = vectors.pop(), vectors[-1], codes[i]
            inserted = []
            while after[state] + DELETE != here[state] and here[FOLLOWING[state]] + INSERT == here[state]:
                state = FOLLOWING[state]
                inserted.append(ROLE[state])
                edits.append("I")
            extra = TRUNCATED if code & CUT_OFF else 0
            kept = KEEPS.get((state, code & 3))
            if after[state] + DELETE == here[state]:
                edits.append("D")
                changes.append((i, inserted, None, []))
            elif kept is not None and not code & MUST_GO and after[kept] + extra == here[state]:
                state = kept
                edits.append("K")
                if inserted:
                    changes.append((i, inserted, "", []))
            else:
                state = FOLLOWING[state]
                edits.append("R")
                changes.append((i, inserted, ROLE[state], []))
    if last:
        inserted = []
        while END[state]:
            state = FOLLOWING[state]
            inserted.append(ROLE[state])
            edits.append("I")
        if inserted:
            if changes and changes[-1][0] == len(codes) - 1:
                changes[-1] = (*changes[-1][:3], inserted)
            else:
                changes.append((len(codes) - 1, [], "", inserted))
    return "".join(edits), state, changes


def damaged(rows: DataFrame) -> DataFrame:
    """conv, none, turn, role and text of the rows that the damage leaves; nulls are one space."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(words("text"), ".!?", "")).otherwise(words("text"))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("none"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(words("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Number the rows of each conversation from 0 by turn, nulls first; ties by role and text.

    Rows that are equal in all of these are alike, so their order means nothing.
    """
    numbered = number_by_order(rows, KEY, ["turn", "role", "text"], "pos")
    return numbered.withColumn("pos", F.col("pos") - 1)


def diagnosed(rows: DataFrame) -> DataFrame:
    """conv, none, pos, turn, code and the first fault of each row.

    The first row of equal ones is found by an aggregate that reduces before its shuffle and
    joined back by its place, so that no join has a hot key.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    facts = rows.select(
        *KEY,
        "pos",
        "turn",
        F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")).alias("same"),
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"),
        blank.alias("blank"),
        (~blank & ~ended).alias("open"),
    )
    firsts = facts.groupBy(*KEY, "same").agg(F.min("pos").alias("pos")).select(*KEY, "pos", F.lit(True).alias("first"))
    told = facts.join(firsts, [*KEY, "pos"], "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    cut_off = F.col("open") & ~duplicate
    code = F.col("initial") + F.when(F.col("blank") | duplicate, MUST_GO).otherwise(0) + F.when(cut_off, CUT_OFF).otherwise(0)
    return told.select(*KEY, "pos", "turn", code.alias("code"), "blank", duplicate.alias("duplicate"), cut_off.alias("truncated"))


def _blocks(faults: DataFrame, block: int) -> DataFrame:
    """conv, none, block, lead (code of the row before, or -1), codes in order, and whether it is the last."""
    at = F.expr(f"pos div {block}")
    guest = F.when(F.col("pos") % block == block - 1, F.array(at, at + 1)).otherwise(F.array(at))
    rows = faults.select(*KEY, F.col("pos").cast("long"), F.col("code").cast("int"), F.explode(guest).alias("block"))
    blocks = rows.groupBy(*KEY, "block").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    own = F.filter("rows", lambda r: r["pos"] >= F.col("block") * block)
    led = F.when(F.col("rows")[0]["pos"] < F.col("block") * block, F.col("rows")[0]["code"]).otherwise(-1)
    cut = blocks.select(*KEY, "block", led.alias("lead"), F.transform(own, lambda r: r["code"]).alias("codes"))
    cut = cut.filter(F.size("codes") > 0)
    lasts = cut.groupBy(*KEY).agg(F.max("block").alias("top"))
    return cut.join(lasts, KEY)


# Columns of what a task makes of a block, for Spark and for Arrow.
_AT = ("conv long, none boolean, block long", [("conv", pa.int64()), ("none", pa.bool_()), ("block", pa.int64())])
_EFFECT = ("value array<long>", [("value", pa.list_(pa.int64()))])
_CHANGE = pa.struct([("pos", pa.int64()), ("before", pa.list_(pa.string())), ("role", pa.string()), ("after", pa.list_(pa.string()))])
_WALKED = (
    "audit string, cost long, illegal long, changes array<struct<pos:long,before:array<string>,role:string,after:array<string>>>",
    [("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("changes", pa.list_(_CHANGE))],
)


def _per_block(blocks: DataFrame, schema: tuple[str, list], run: Callable[[dict], dict]) -> DataFrame:
    """Apply ``run`` to each block; key columns are carried."""
    fields, arrow = f"{_AT[0]}, {schema[0]}", pa.schema(_AT[1] + schema[1])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [{"conv": r["conv"], "none": r["none"], "block": r["block"], **run(r)} for r in rows]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return blocks.mapInArrow(apply, fields)


def scanned(parts: DataFrame, first: list[int], combine, forward: bool, fan: int = FAN) -> DataFrame:
    """What reaches each block: ``first``, taken through all blocks on its way.

    ``parts`` has conv, none, block and value, the block's effect as a list; ``combine(a, b)`` is
    the effect of b after a, and a state or vector is an effect that ignores where it starts.
    Blocks are combined in groups of ``fan``, level by level, and told from the top down, so
    no task holds more than ``fan`` of them.
    """
    fields = "conv long, none boolean, block long, value array<long>"

    def whole(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"], reverse=not forward)
        value = rows[0]["value"]
        for r in rows[1:]:
            value = combine(value, r["value"])
        return pa.Table.from_pylist([{**rows[0], "block": rows[0]["block"] // fan, "value": value}], group.schema)

    def reach(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"], reverse=not forward)
        value, out = rows[0]["reaches"], []
        for r in rows:
            out.append({"conv": r["conv"], "none": r["none"], "block": r["block"], "value": value})
            value = combine(value, r["value"])
        return pa.Table.from_pylist(out, group.select(["conv", "none", "block", "value"]).schema)

    levels = [parts.select(*KEY, "block", "value")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) >= fan:
        grouped = levels[-1].groupBy(*KEY, F.expr(f"block div {fan}").alias("part"))
        levels.append(staged(grouped.applyInArrow(whole, fields), "dialogue-level"))
    reached = levels[-1].select(*KEY).distinct().select(*KEY, F.lit(0).cast("long").alias("part"), F.lit(first).cast("array<long>").alias("reaches"))
    for level in reversed(levels):
        met = level.withColumn("part", F.expr(f"block div {fan}")).join(reached, [*KEY, "part"])
        told = staged(met.groupBy(*KEY, "part").applyInArrow(reach, fields), "dialogue-reach")
        reached = told.withColumnsRenamed({"block": "part", "value": "reaches"})
    return told


def _times(a: list[int], b: list[int]) -> list[int]:
    """Effect b on vectors after effect a: least sums; a vector is an effect with one column."""
    width = len(a) // 4
    return [min(NEVER, *(b[4 * i + j] + a[width * j + k] for j in range(4))) for i in range(4) for k in range(width)]


def _then(a: list[int], b: list[int]) -> list[int]:
    return [b[s] for s in a]


def _matrix(row: dict) -> dict:
    units = [tuple(0 if i == j else NEVER for i in range(4)) for j in range(4)]
    columns = [_back(row["codes"], u) for u in units]
    return {"value": [min(columns[j][i], NEVER) for i in range(4) for j in range(4)]}


def _state_map(row: dict) -> dict:
    last = row["block"] == row["top"]
    return {"value": [_end_state(row["codes"], tuple(row["end"]), s, last) for s in range(4)]}


def _end_state(codes: list[int], end: Vector, state: int, last: bool) -> int:
    # A state that no finite cost reaches is never entered.
    return walk(codes, end, state, last)[1] if _back(codes, end)[state] < NEVER else state




def _walked(block: int) -> Callable[[dict], dict]:
    def run(row: dict) -> dict:
        codes, end, start = row["codes"], tuple(row["end"]), row["start"]
        edits, state, changes = walk(codes, end, start, row["block"] == row["top"])
        initials = [c & 3 for c in ([row["lead"]] if row["lead"] >= 0 else []) + codes]
        return {
            "audit": edits,
            "cost": _back(codes, end)[start] - end[state] if row["block"] < row["top"] else _back(codes, end)[start],
            "illegal": sum(pair not in LEGAL for pair in zip(initials, initials[1:])),
            "changes": [{"pos": row["block"] * block + i, "before": b, "role": r, "after": a} for i, b, r, a in changes],
        }

    return run


def edited(faults: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """audit, cost, illegal and changed rows of each block of each conversation."""
    blocks = staged(_blocks(faults, block), "dialogue-blocks")
    state = F.lit(NONE).cast("long")
    short = blocks.filter("top = 0").withColumns({"end": F.lit(list(END)).cast("array<long>"), "start": state})
    short = _per_block(short, _WALKED, _walked(block))
    long = blocks.filter("top > 0")
    if long.isEmpty():
        return short
    at = [*KEY, "block"]
    effects = staged(_per_block(long, _EFFECT, _matrix), "dialogue-effects")
    ends = scanned(effects, list(END), _times, forward=False, fan=fan).withColumnRenamed("value", "end")
    long = staged(long.join(ends, at), "dialogue-ends")
    maps = staged(_per_block(long, _EFFECT, _state_map), "dialogue-maps")
    starts = scanned(maps, [NONE], _then, forward=True, fan=fan)
    long = long.join(starts.select(*at, F.col("value")[0].alias("start")), at)
    return short.unionByName(_per_block(long, _WALKED, _walked(block)))


def repaired_lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, none, pos and the (role, text) lines that a row becomes: none, itself, or with insertions."""
    changes = edits.select(*KEY, F.explode("changes").alias("c")).select(*KEY, "c.*")
    blank = lambda roles: F.transform(F.coalesce(roles, F.array().cast("array<string>")), lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    changed = F.col("before").isNotNull()
    line = F.struct(F.when(changed & (F.col("c_role") != ""), F.col("c_role")).otherwise(F.col("role")).alias("role"), F.col("text").alias("text"))
    own = F.when(changed & F.col("c_role").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(line))
    met = rows.join(changes.withColumnRenamed("role", "c_role"), [*KEY, "pos"], "left")
    return met.select(*KEY, "pos", F.concat(blank(F.col("before")), own, blank(F.col("after"))).alias("lines"))


def _hashed(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines.

    Rows of a conversation stream through one hash in order; a hash has no parallel form, but
    no more than a batch of rows is ever held.
    """
    texts = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    rows = lines.filter(F.size("lines") > 0).select(*KEY, "pos", F.array_join(texts, "\n").alias("text"))
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else ((), (), ())
            kinds = (pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*KEY, "repaired"])

        for part in batches:
            for conv, none, text in zip(*(part.column(c).to_pylist() for c in (*KEY, "text"))):
                if (conv, none) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (conv, none), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode("utf-8", "surrogatepass"))
            yield batch()
            out = []
        if key:
            out.append((*key, digest.hexdigest()))
        yield batch()

    return rows.select(*KEY, "text").mapInArrow(run, "conv long, none boolean, repaired string")


def repair(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Damage the conversations, find their faults, and mend their structure at least cost.

    One row per conv_id of the input. Nulls in a text or role count as one space, rows without
    a conv_id are one conversation, rows without a turn come first. Equal turns are ordered by
    role and text, and of equal rows all but one are duplicates. A conversation that loses all
    its rows has zeros and empty texts; an empty table gives none. Only the four columns are read.
    """
    rows = ordered(damaged(conversations))
    faults = staged(diagnosed(rows), "dialogue-faults")
    edits = staged(edited(faults, block, fan), "dialogue-edits")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    turns = faults.groupBy(*KEY, "turn").agg(*map(count, ("blank", "duplicate", "truncated")))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counted = turns.groupBy(*KEY).agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    pieces = F.sort_array(F.collect_list(F.struct("block", "audit")))
    audits = edits.groupBy(*KEY).agg(count("illegal"), count("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    found = counted.join(audits, KEY).join(_hashed(repaired_lines(rows, edits)), KEY, "left")
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.join(found, KEY, "left").select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
