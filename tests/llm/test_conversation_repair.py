"""Operator 13 against a uniform-cost search over whole audits and plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from citeflow.llm import conversation_repair as C
from citeflow.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, place long, audit string"
PATTERN = re.compile("(s?(ua)+)?")


def rows(seed=3, convs=60):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(r.randint(1, 9)):
            role = "system" if t == 0 and r.random() < 0.5 else ("user", "assistant", "user", "assistant", "tool", "", None, "system")[min(r.randint(t % 2, 14), 7) if r.random() < 0.2 else t % 2]
            text = r.choice(["Fine.", "Well!", "Yes?", "no end", " \n", "", None, f"text {r.random()}.", "trail. \t\n", "ends. ", "x" * 5000 + "."])
            out.append((c, t + r.choice([0, 0, 0, 3]) if r.random() < 0.9 else None, role, text, 1, "a"))
    return [*out, out[3], out[3], (None, 0, "user", "Hi.", 1, ""), (None, 1, "assistant", "Ho.", 1, ""), (None, None, None, None, None, None)]


def slow_damage(data):
    for conv, turn, role, text, *_ in data:
        role, text = (" " if x is None else x for x in (role, text))
        shown = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(shown.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(items):
    """Uniform-cost search over (cost, audit) with the roles written out; accepting states by the pattern itself."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, initials, out = heapq.heappop(heap)
        state = (i, initials[:1] == "s", initials[-1:], len(initials) > 1)
        if state in seen:
            continue
        seen.add(state)
        if i == len(items) and PATTERN.fullmatch(initials):
            return cost, audit, out

        def go(extra, edit, taken, added):
            new = initials + "".join(role[:1] for role, _ in added)
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + extra, audit + edit, i + taken, new, (*out, *added)))
        for role in ("user", "assistant"):
            go(5, "I", 0, [(role, "")])
        if i < len(items):
            role, text, fault = items[i]
            go(2, "D", 1, [])
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(stays, "K", 1, [(role, text)])
                for new in ("user", "assistant"):
                    go(1 + stays, "R", 1, [(new, text)])


def brute(data):
    convs = {}
    for conv, turn, role, text in slow_damage(data):
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role, text, turn))
    out = []
    for conv in {r[0] for r in data}:
        mine = sorted(convs.get(conv, []))
        turns = [m[4] for m in mine if m[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        items, seen, n = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text, _ in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none"
            seen.add((role, text))
            n[fault] = n.get(fault, 0) + 1
            items.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        cost, audit, kept = cheapest(items)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_equals_brute_force(spark, tmp_dir):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_dir}/conversations.parquet")
    found = queries.op13_conversation_repair(spark, tmp_dir)
    assert found.columns == COLUMNS and [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows())


def test_empty_table(spark, tmp_dir):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_dir}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, tmp_dir).collect() == []


def test_long_conversations_are_searched_in_chunks(spark):
    """One conversation of 150 rows in chunks of 4 gives the report and the rows of a whole search."""
    r = random.Random(8)
    data = [(7, t, r.choice(["user", "assistant", "assistant", "user", "system", "x"]), r.choice(["Yes.", f"n {t}.", f"cut {t}", ""]), 0, "") for t in range(150)]
    data += [(8, 0, "user", "Hi.", 0, ""), (8, 1, "assistant", "Ho.", 0, "")]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    both = []
    for chunk in (4, C.CHUNK):
        report, repaired = C.repair(df, chunk=chunk)
        lines = [(x.conv, x.role, x.text) for x in repaired.orderBy("conv", "place", "nth").collect()]
        both.append((sorted(map(tuple, report.collect())), lines, sorted(map(tuple, C.text_digests(repaired).collect()))))
    assert both[0] == both[1]
    codes = both[1][0][0][-1]
    assert PATTERN.fullmatch("".join(role[:1] for conv, role, _ in both[1][1] if conv == 7)) and set(codes) <= set("DIKR")


def slow_search(codes):
    heap, done = [(0, "", 0, C.START)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes) and state in (C.START, C.ASSISTANT):
            return cost, audit
        for edit, more, taken, to in C.edits(codes[i] if i < len(codes) else None, state):
            heapq.heappush(heap, (cost + more, audit + edit, i + taken, to))


@pytest.mark.parametrize("seed", range(4))
def test_search_is_cheapest_and_least(seed):
    r = random.Random(seed)
    for _ in range(600):
        codes = "".join(r.choice(list(C.KEPT)) for _ in range(r.randint(0, 12)))
        want = slow_search(codes)
        assert C.search(codes) == want
        chunks = [codes[i : i + 3] for i in range(0, len(codes), 3)]
        if len(chunks) > 1:
            ends = C.fold([C.chunk_table(c) for c in chunks[:-1]], [C.search(chunks[-1], s)[0] for s in range(4)])
            parts = [C.search(c, s, None if e < 0 else e) for c, (s, e) in zip(chunks, ends)]
            assert (sum(p[0] for p in parts), "".join(p[1] for p in parts)) == want


def test_costs_by_hand():
    ok = {c: C.letter(i, 0) for i, c in enumerate("sua")}
    assert C.search(ok["s"] + ok["u"] + ok["a"]) == (0, "KKK")
    assert C.search("") == (0, "")
    assert C.search(ok["u"]) == (2, "D")
    assert C.search(ok["u"] + ok["u"]) == (1, "KR")
    assert C.search(ok["a"] + ok["u"] + ok["a"]) == (2, "DKK")
    assert C.search(C.letter(1, 3) + ok["a"]) == (4, "DD")
