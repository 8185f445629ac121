"""Operator 13: repair of conversation structure by iterative-deepening A*.

A conversation is repaired by an edit a row, in order: Delete, Keep, Rerole (to user or assistant), and Inserts of empty
user or assistant rows anywhere, so that the role initials become ``(s?(ua)+)?``. Costs are in ``COST``. Blank rows and
repeats (role and text seen earlier) must be deleted; a truncated row that stays costs extra. The answer is the cheapest
sequence of edits, among equals the one whose initials are least in ASCII order.

Search. States are (row, role before); the roles after which a row stands decide which role an edit may give, so an audit
string fixes the result. Depth-first search tries edits in ASCII order (D, I, K, R) while cost so far plus a lower bound of
the rest stays within a bound; if it fails the bound rises to the least sum that was beyond it. The lower bound is the exact
cost of a relaxed rest that may end after any role (within a long conversation: the chunk's rest). States that failed with some budget are kept in a transposition
table, over all bounds, and not entered again with as little. The first accepting path is then cheapest and least.

Plan. Rows are put in order by one range shuffle (all keys, then a tie breaker), so a conversation of any size is spread
over tasks and numbered without a window. Repeats are found by an aggregate (role, text hash) and a join. The search sees
one letter a row, ``CHUNK`` rows at a time. A conversation of one chunk is searched whole. A longer one is searched
chunk by chunk for all pairs of roles before and after it; the small tables of costs are folded, from the end for the cheapest
rest and from the start for the least audit, and each chunk is searched once more between its two roles. (Inserts stand
before a row of their chunk, so no audit of a chunk begins another, and the least whole is made of least chunks.)

Cases: null ids are a conversation like others; a null role or text counts as one space; null turns come first; rows of equal turn
are ordered by role and text; an empty or other role can not be kept; repeated rows are repeats; very long texts are
only hashed and matched; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import cut_lineage, map_arrow

#: Costs of the edits, and of a truncated row that stays.
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED = 5
CHUNK = 4096
#: A row as a letter: role initial (s, u, a, other) and first fault (none, blank, duplicate, truncated).
INITIALS = "sua"
FAULTS = ("none", "blank", "duplicate", "truncated")
#: Roles before a row: none, system, user, assistant. ``NEXT`` is the role an inserted or changed row gets.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("", "system", "user", "assistant")
FAR = 1 << 60


def letter(initial: int, fault: int) -> str:
    return chr(97 + initial * 4 + fault)


def _row(code: str) -> tuple[int, int]:
    return divmod(ord(code) - 97, 4)


#: role that a row of this letter has when kept (0: it can not be kept), whether it must go, what it costs extra if it stays
KEPT = {letter(i, f): (i + 1 if i < 3 and f in (0, 3) else 0) for i in range(4) for f in range(4)}
GOES = {letter(i, f): f in (1, 2) for i in range(4) for f in range(4)}
EXTRA = {letter(i, f): TRUNCATED * (f == 3) for i in range(4) for f in range(4)}


def edits(code: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, role after) in ASCII order, before a row of this letter (None: after the last row)."""
    insert = ("I", COST["I"], 0, NEXT[state])
    if code is None:
        return [insert]
    out = [("D", COST["D"], 1, state), insert]
    if KEPT[code] == NEXT[state] or KEPT[code] == SYSTEM and state == START:
        out.append(("K", COST["K"] + EXTRA[code], 1, KEPT[code]))
    if not GOES[code]:
        out.append(("R", COST["R"] + EXTRA[code], 1, NEXT[state]))
    return out


EDITS = {(code, state): edits(code, state) for code in [*KEPT, None] for state in range(4)}


def relaxed(codes: str, end: int | None) -> list[tuple[int, ...]]:
    """For each row and role before it, the least cost of the rest if a conversation may end after any role (a chunk: ``end``)."""
    out = [tuple(0 if end in (None, s) else FAR for s in range(4))] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        now = [min(cost + out[i + 1][to] for _, cost, taken, to in EDITS[codes[i], s] if taken) for s in range(4)]
        for _ in range(2):  # an insert before the row, twice at most: roles then repeat
            now = [min(now[s], COST["I"] + now[NEXT[s]]) for s in range(4)]
        out[i] = tuple(now)
    return out


def search(codes: str, start: int = START, end: int | None = None) -> tuple[int, str]:
    """(cost, edits) of the cheapest and then least repair of rows from role ``start``; ``end`` is the role to end with, without
    inserts after the last row, or None for the end of a conversation."""
    n, rest = len(codes), relaxed(codes, end)
    failed: dict[tuple[int, int], int] = {}  # state -> the largest budget that did not reach an end
    bound = rest[0][start]
    while True:
        beyond = FAR
        path: list[str] = []
        stack = [(0, start, 0, iter(EDITS[codes[0] if n else None, start]))]
        if not n and (start == end if end is not None else start in (START, ASSISTANT)):
            return 0, ""
        while stack:
            i, state, spent, left = stack[-1]
            for edit, cost, taken, to in left:
                at, total = i + taken, spent + cost
                if at == n and not taken and end is not None:
                    continue
                least = total + rest[at][to]
                if least > bound:
                    beyond = min(beyond, least)
                    continue
                lost = failed.get((at, to), -1)
                if lost >= bound - total:
                    beyond = min(beyond, total + lost + 1)
                    continue
                path.append(edit)
                if at == n and (to == end if end is not None else to in (START, ASSISTANT)):
                    return total, "".join(path)
                stack.append((at, to, total, iter(EDITS[codes[at] if at < n else None, to])))
                break
            else:
                failed[i, state] = max(failed.get((i, state), -1), bound - spent)
                stack.pop()
                if path:
                    path.pop()
        bound = beyond


def reachable(codes: str, start: int, end: int) -> bool:
    """Whether rows can take a conversation from one role to another (users and assistants can always be inserted)."""
    if end in (START, SYSTEM):
        return start == end or start == START and end == SYSTEM and any(KEPT[c] == SYSTEM for c in codes)
    return True


def chunk_table(codes: str) -> tuple[list[int], list[int]]:
    """Costs for all 16 (role before, role after) pairs, and the order of their edits among those with the same role before."""
    found = {(s, e): search(codes, s, e) for s in range(4) for e in range(4) if reachable(codes, s, e)}
    cost = [found[s, e][0] if (s, e) in found else FAR for s in range(4) for e in range(4)]
    order = []
    for s in range(4):
        by = sorted((e for e in range(4) if (s, e) in found), key=lambda e: found[s, e][1])
        order += [by.index(e) if e in by else 4 for e in range(4)]
    return cost, order


def fold(tables: list[tuple[list[int], list[int]]], last: list[int]) -> list[tuple[int, int]]:
    """(role before, role after) of every chunk but the last, then (role before, -1) of the last."""
    rest = [last]
    for cost, _ in reversed(tables):
        rest.append([min(cost[4 * s + e] + rest[-1][e] for e in range(4)) for s in range(4)])
    rest.reverse()
    out, state = [], START
    for j, (cost, order) in enumerate(tables):
        best = [e for e in range(4) if cost[4 * state + e] < FAR and cost[4 * state + e] + rest[j + 1][e] == rest[j][state]]
        end = min(best, key=lambda e: order[4 * state + e])
        out.append((state, end))
        state = end
    return [*out, (state, -1)]


# -- rows in order ------------------------------------------------------------------------------------------------------


def classified(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """Rows as conv, turn, role, text, place (ascending in conversation order), chunk, fault, initial."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    keys = ["conv", "turn", "role", "text", "tie"]
    placed = (df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .drop("tie").withColumn("place", F.monotonically_increasing_id()))
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    placed = cut_lineage(placed.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).withColumn(
        "fault", F.when(solid == "", 1).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)), "turns")
    again = placed.groupBy("conv", "digest").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = again.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "earliest")
    joined = placed.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when((F.col("fault") != 1) & (F.col("place") > F.col("earliest")), 2).otherwise(F.col("fault"))
    initial = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    return joined.select("conv", "turn", "role", "text", "place", F.expr(f"place div {chunk}").alias("chunk"),
                         fault.alias("fault"), initial.alias("initial"))


def chunks_of(turns: DataFrame) -> DataFrame:
    """One row a conversation and chunk: codes (one letter a row), and raw (the initials as they were, ``?`` for others)."""
    char = F.chr(97 + F.col("initial") * 4 + F.col("fault"))
    listed = turns.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", char.alias("c")))).alias("rows"))
    return listed.select("conv", "chunk", F.col("rows")[0]["place"].alias("first"), F.array_join(F.transform("rows", lambda r: r["c"]), "").alias("codes"))


def audits(turns: DataFrame) -> DataFrame:
    """One row a conversation and chunk: conv, chunk, first (place of its first row), codes, state (role before), cost, audit."""
    chunks = cut_lineage(chunks_of(turns), "chunks")
    many = chunks.groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n"), F.max("chunk").alias("final")).where("n > 1")
    long = chunks.join(many, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "chunk", "codes", (F.col("chunk") == F.col("final")).alias("is_last"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [([search(c, s)[0] for s in range(4)], []) if last else chunk_table(c)
                    for c, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], ints), pa.array([m[1] for m in made], ints)],
                                             names=["conv", "chunk", "cost", "order"])

    conv = turns.schema["conv"].dataType.simpleString()
    folded = map_arrow(long, tables, f"conv {conv}, chunk long, cost array<long>, `order` array<long>").groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "cost", "order"))).alias("all"))

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk_rows in enumerate(batch.column(1).to_pylist()):
                ends = fold([(r["cost"], r["order"]) for r in chunk_rows[:-1]], chunk_rows[-1]["cost"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * len(ends), batch.schema.field(0).type), pa.array([r["chunk"] for r in chunk_rows], pa.int64()),
                    pa.array([s for s, _ in ends], pa.int64()), pa.array([e for _, e in ends], pa.int64())], names=["c", "k", "state", "end"])

    roles = map_arrow(folded, folds, f"c {conv}, k long, state long, `end` long")
    between = chunks.join(roles, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").select(
        "conv", "chunk", "first", "codes", F.coalesce("state", F.lit(START)).cast("long").alias("state"), F.coalesce("end", F.lit(-1)).cast("long").alias("end"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [search(c, s, None if e < 0 else e) for c, s, e in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array([m[0] for m in made], pa.int64()),
                                              pa.array([m[1] for m in made], pa.string())], names=["conv", "chunk", "first", "codes", "state", "cost", "audit"])

    return cut_lineage(map_arrow(between, solve, f"conv {conv}, chunk long, first long, codes string, state long, cost long, audit string"), "audits")


def repaired_rows(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations, row by row: conv, place, nth (inserts before a row, then the row), role, text.

    A chunk's edits meet its rows in one task; a conversation of many chunks is spread."""
    conv = turns.schema["conv"].dataType.simpleString()
    plan = solved.select("conv", "chunk", F.lit(-1).cast("long").alias("place"), F.col("audit").alias("role"), F.col("state").cast("string").alias("text"))
    both = plan.unionByName(turns.select("conv", "chunk", "place", "role", "text"))
    dealt = both.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, state, todo = ["conv", "place", "nth", "role", "text"], START, iter("")
        nth, last = 0, None
        out: list[tuple] = []

        def inserts(conv_id, place, upto: bool):
            """Takes edits from the plan: inserts go out; returns the edit of the next row (None after the last)."""
            nonlocal state, nth
            nth = 0
            for e in todo:
                if e != "I":
                    return e
                state = NEXT[state]
                out.append((conv_id, place, nth, ROLE[state], ""))
                nth += 1
            return None

        def batch_of():
            kinds = (None, pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*out)) if out else [()] * 5
            made = pa.RecordBatch.from_arrays([pa.array(c, k or conv_type) for c, k in zip(cols, kinds)], names=names)
            out.clear()
            return made

        conv_type = pa.int64()
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv_id, _chunk, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if place < 0:
                    if last is not None:
                        inserts(*last, True)
                    todo, state = iter(role), int(text)
                    continue
                last = (conv_id, place + 1)  # inserts after the last row stand behind it
                e = inserts(conv_id, place, False)
                if e == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                    out.append((conv_id, place, nth, role, text))
                elif e == "R":
                    state = NEXT[state]
                    out.append((conv_id, place, nth, ROLE[state], text))
            yield batch_of()
        if last is not None:
            inserts(*last, True)
            yield batch_of()

    return map_arrow(dealt, run, f"conv {conv}, place long, nth long, role string, text string")


def text_digests(rows: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines joined by newlines, read as a stream (a hash is sequential, so a
    conversation is read by one task, but never held)."""
    conv = rows.schema["conv"].dataType.simpleString()
    dealt = rows.select("conv", "place", "nth", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv").sortWithinPartitions("conv", "place", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, h = none, None
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, sums = [], []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
                if h is None or key != now:
                    if h is not None:
                        ids.append(now)
                        sums.append(h.hexdigest())
                    now, h = key, hashlib.sha256(line)
                else:
                    h.update(b"\n")
                    h.update(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], names=["conv", "sha"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()])], names=["conv", "sha"])

    return map_arrow(dealt, run, f"conv {conv}, sha string")


def _pairs_illegal(raw: Column) -> Column:
    """Neighbouring role initials that are not su, ua or au, in a string of initials."""
    legal = sum((F.length(raw) - F.length(F.regexp_replace(raw, f"{a}(?={b})", "")) for a, b in ("su", "ua", "au")), F.lit(0))
    return F.greatest(F.length(raw) - 1, F.lit(0)) - legal


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows). The report has one row a conversation: conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit. The repaired rows are conv, place, nth, role, text, in the order of place and nth."""
    turns = cut_lineage(classified(rows, conv_col, turn_col, role_col, text_col, chunk), "classified")
    solved = audits(turns)
    raw = F.translate("codes", "".join(letter(i, f) for i in range(4) for f in range(4)), "".join(c * 4 for c in "sua?"))
    count = lambda f: (F.length("codes") - F.length(F.translate("codes", "".join(letter(i, f) for i in range(4)), ""))).cast("long")
    pieces = solved.select("conv", "cost", *(count(f).alias(FAULTS[f]) for f in (1, 2, 3)), _pairs_illegal(raw).cast("long").alias("illegal"),
                           F.struct("chunk", raw.alias("raw"), "audit").alias("piece"))
    whole = pieces.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated", "illegal")),
                                       F.array_sort(F.collect_list("piece")).alias("pieces"))
    # neighbours across chunks: the last initial of one and the first of the next
    joints = F.expr("transform(slice(pieces, 2, greatest(size(pieces) - 1, 0)), (p, i) -> concat(right(pieces[i].raw, 1), left(p.raw, 1)))")
    across = F.size(F.filter(joints, lambda j: ~j.isin("su", "ua", "au"))).cast("long")
    turn = turns.groupBy(F.col("conv").alias("c")).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long")
    report = whole.join(turn, F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + across).alias("illegal"), "cost",
        F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"))
    return report, repaired_rows(turns, solved)


# -- damage ---------------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with one planted fault in four, by crc32 of ``conversation:turn`` (nulls: one space) modulo 20: 0 drops a row, 1
    empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes its role user."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    out = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), kind.alias("kind"),
                      F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col).cast("string"), F.lit(" "))).alias("role"),
                      F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    twice = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.where("kind <> 0").withColumn("copy", F.explode(twice)).drop("kind", "copy")
