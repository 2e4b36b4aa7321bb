import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from motorfisc.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile(r"(s?(ua)+)?")


def every_way(kinds, most_inserts=2):
    """All edits of a short conversation, tried one by one: the least (cost, audit) whose roles are legal."""
    best = None
    gaps = [list(product(("Iu", "Ia"), repeat=k)) for k in range(most_inserts + 1)]
    for inserts in product([x for g in gaps for x in g], repeat=len(kinds) + 1):
        own = [["D"] if k == "x" else ["D", "Ru", "Ra", "K" + k.lower()] for k in kinds]
        for edits in product(*own):
            steps = [*inserts[0], *[s for e, gap in zip(edits, inserts[1:], strict=True) for s in (e, *gap)]]
            if LEGAL.fullmatch("".join(s[1] for s in steps if s != "D")):
                cost = sum({"I": 5, "D": 2, "R": 1, "K": 0}[s[0]] for s in steps)
                cost += sum(5 for e, k in zip(edits, kinds, strict=True) if e != "D" and k.isupper())
                best = min(best or (cost, "~"), (cost, "".join(s[0] for s in steps)))
    return best


@pytest.mark.parametrize("size", [0, 1, 2])
def test_cells_are_the_cheapest_of_all_edits(size):
    for kinds in product("suaoSUAx", repeat=size):
        assert repair.cheapest(repair.parsed("".join(kinds))) == every_way(kinds), kinds


def test_some_rows_more_against_all_edits():
    rng = random.Random(1)
    for _ in range(25):
        kinds = "".join(rng.choice("suaoSUAOx") for _ in range(4))
        assert repair.cheapest(repair.parsed(kinds)) == every_way(kinds, 1), kinds


def test_all_splits_of_a_span_give_the_same_cells():
    rng = random.Random(2)
    for _ in range(6):
        kinds = "".join(rng.choice("suaoUAx") for _ in range(11))
        chart = {(i, i + 1): repair.row_cells(k) for i, k in enumerate(kinds)}
        for length in range(2, len(kinds) + 1):
            for i in range(len(kinds) - length + 1):
                found = {repair.joined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)}
                assert len(found) == 1
                chart[i, i + length] = found.pop()
        assert chart[0, len(kinds)] == repair.parsed(kinds)


def search(rows):
    """rows of (role, text, fault): cheapest edits by a search over places and states, and the lines that they give."""
    moves, seen = {"": "u", "s": "u", "a": "u", "u": "a"}, set()
    todo = [(0, "", 0, "", ())]
    while True:
        cost, audit, at, state, lines = heapq.heappop(todo)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (at, state) in seen:
            continue
        seen.add((at, state))
        after = moves[state]
        full = {"u": "user", "a": "assistant"}[after]
        heapq.heappush(todo, (cost + 5, audit + "I", at, after, (*lines, full + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(todo, (cost + 1 + more, audit + "R", at + 1, after, (*lines, f"{full}:{text}")))
                if role[:1] == after or role[:1] == "s" and state == "":
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))


def plain(rows):
    """The contract, row by row; rows of one turn stand by role and the text's SHA-256."""
    out, convs = [], {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        sp = lambda x: " " if x is None else str(x)
        role, text = sp(role), sp(text)
        fate = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, lines = search([(r, t, f) for (_, r, t), f in zip(kept, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_the_plain_contract_on_a_whole_table(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{larger}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op11_conversation_repair(spark, larger)) == plain(rows)


def test_nulls_ties_repeats_odd_roles_and_a_hot_conversation(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", " \t", "One.", "two!  ", "three", "four?\n", "x" * 3000, "é."])
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "usher"])
    rows = [(rng.choice([None, 1, 2, 3, -4]), rng.choice([None, 1, 2, 2, 3, 5, 900]), role(), text()) for _ in range(150)]
    rows += [(77, t // 2 if t % 9 else None, role(), rng.choice([f"{t}.", f"{t}", text()])) for t in range(900)]
    rows += [(5, 1, "user", "again.")] * 700 + [(6, -(2**63), "user", "a."), (6, 2**63 - 1, "assistant", "b.")]
    conversations = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, n int, key string").repartition(5)
    want = [(r[0], min(r[1], 2**63 - 1), *r[2:]) for r in plain(rows)]
    assert got(repair.summary(conversations, repair.damaged(conversations))) == want


def test_every_row_dropped_and_no_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "a.")], "conv_id int, turn int, role string, text string")
    assert got(repair.summary(df, repair.damaged(df))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert got(repair.summary(df.limit(0), repair.damaged(df.limit(0)))) == []


def test_repaired_rows_are_whole_conversations_in_order(spark):
    rows = [("c", 1, "system", "s."), ("c", 2, "user", "q?"), ("c", 3, "user", "q2?"), ("c", 4, "assistant", "a."), ("c", 5, "tool", "t"), ("c", 6, "assistant", "e."), (None, 1, "assistant", "x.")]
    given = repair.rows_of(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    out = repair.repaired(given, repair.audits(given)).collect()
    assert [(r.at, r.edit, r.role, r.text) for r in out if r.key == "=c"] == [(0, "K", "system", "s."), (1, "K", "user", "q?"), (2, "R", "assistant", "q2?"), (3, "R", "user", "a."), (4, "K", "assistant", "e.")]
    assert [r for r in out if r.key == ""] == []
