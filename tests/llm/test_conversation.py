import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from ledgerlens.llm import conversation as C
from ledgerlens.llm.queries import ORACLES, QUERIES

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, audit string, `again` int, LIVE string"


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "none"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns):
    """All edits of all turns with up to two inserts in each place."""
    faults, best = faults_of(turns), None
    ways = [["D"] if f in ("blank", "duplicate") else ["D", "K", "U", "A"] for f in faults]
    for edits in itertools.product(*ways):
        for inserts in itertools.product(["", "U", "A", "UA", "AU"], repeat=len(turns) + 1):
            audit, made, cost = "", [], 0
            for i in range(len(turns) + 1):
                for c in inserts[i]:
                    audit, cost = audit + "I", cost + 5
                    made.append(("user" if c == "U" else "assistant", ""))
                if i == len(turns):
                    break
                e, (role, text) = edits[i], turns[i]
                if e == "D":
                    audit, cost = audit + "D", cost + 2
                    continue
                audit, cost = audit + ("K" if e == "K" else "R"), cost + (e != "K") + 5 * (faults[i] == "truncated")
                made.append((role if e == "K" else "user" if e == "U" else "assistant", text))
            if all(r for r, _ in made) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return best


def searched(turns):
    repair, out = C.Repair(), []
    for (role, text), fault in zip(turns, faults_of(turns), strict=True):
        repair.turn(role, text.encode(), fault in ("blank", "duplicate"), fault == "truncated")
        out += [x for x, _ in repair.emitted]
        repair.emitted.clear()
    cost, digest = repair.end()
    return cost, "".join(out + [x for x, _ in repair.emitted]), digest


def test_equals_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        turns = [(rng.choice(["system", "user", "user", "assistant", "tool", ""]), rng.choice(["a.", "b!", "c?", "d", "", " ", "e. \n", "é."]))
                 for _ in range(rng.randint(0, 3))]
        assert searched(turns) == cheapest(turns), turns


def table_of_states(turns):
    """The same search with whole audits as strings instead of a tree."""
    live = {"": (0, "", [])}

    def better(to, key):
        if to not in now or key[:2] < now[to][:2]:
            now[to] = key

    def inserted():
        for was in ("", "s", "a"):
            if was in now:
                better("u", (now[was][0] + 5, now[was][1] + "I", [*now[was][2], "user:"]))
        if "u" in now:
            better("a", (now["u"][0] + 5, now["u"][1] + "I", [*now["u"][2], "assistant:"]))

    now = dict(live)
    inserted()
    for (role, text), fault in zip(turns, faults_of(turns), strict=True):
        live, now = now, {}
        for was, (cost, audit, made) in live.items():
            better(was, (cost + 2, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            to = "a" if was == "u" else "u"
            if role[:1] == to or (was == "" and role[:1] == "s"):
                better(role[:1], (cost, audit + "K", [*made, f"{role}:{text}"]))
            better(to, (cost + 1, audit + "R", [*made, ("user" if to == "u" else "assistant") + f":{text}"]))
        inserted()
    cost, audit, made = min(now[s] for s in ("", "a") if s in now)
    return cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def test_long_conversations_and_ties():
    rng = random.Random(7)
    for length in (50, 400):
        for roles in (["user"], ["user", "assistant"], ["system", "user", "assistant", "x"], ["system"]):
            for texts in (lambda i: f"t{i}.", lambda i: rng.choice([f"t{i}.", f"t{i}", "", "same."])):
                turns = [(rng.choice(roles), texts(i)) for i in range(length)]
                assert searched(turns) == table_of_states(turns)


def nodes(repair):
    todo, n = [repair.root], 0
    while todo:
        node = todo.pop()
        n += 1
        todo += node.after.values()
    return n


def test_memory_is_bounded_where_survivors_meet():
    rng, repair, most, emitted = random.Random(1), C.Repair(), 0, 0
    for i in range(20_000):
        repair.turn(rng.choice(["user", "assistant", "assistant", "tool"]), f"t{i}.".encode(), rng.random() < 0.1, rng.random() < 0.1)
        most, emitted = max(most, nodes(repair) if i % 50 == 0 else 0), emitted + len(repair.emitted)
        repair.emitted.clear()
    assert most < 400 and emitted > 19_000
    blank = C.Repair()
    for _ in range(1000):
        blank.turn("user", b"", True, False)
    assert nodes(blank) < 8 and len(blank.emitted) > 990


def expected(rows):
    """The contract over a list of rows, by the table of states."""
    convs = {}
    for conv, turn, role, text in rows:
        turns = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        f = zlib.crc32(key.encode()) % 20
        if f:
            row = turn, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            turns += [row] * (1 + (f == 3))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults = faults_of([t[1:] for t in turns])
        numbers = {t[0] for t in turns} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
                     *table_of_states([t[1:] for t in turns]))
    return out


def odd_rows():
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(["Yes.", "No", None, "", " \n", "é?", "x. \t"]))
            for c in [*range(60), None, -5] for t in [*range(rng.randint(1, 6)), None][rng.randint(0, 1):]]
    rows += [(1000, t, "user", "Same.") for t in range(30)] + [(1001, 5, "user", "a b."), (1001, 5, "assistant", "a b."), (1001, 5, "assistant", "a b.")]
    rows += [(2000, t, "user" if t % 3 else "assistant", f"text {t}" + "." * (t % 2)) for t in range(0, 900, 2)]
    rows += [(3000, 1, "user", "long " * 100_000 + "."), (3000, 2, "assistant", "end.")]
    return rows


def test_defined_cases(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.conversation_audits(frame).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv
    empty = C.conversation_audits(frame.limit(0))
    assert empty.collect() == [] and empty.columns == ["conv_id", *COLUMNS]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[0] != 2000])
    sql = {r[0]: tuple(r[1:]) for r in con.execute(ORACLES["op11_conversation_repair"]).fetchall()}
    assert sql == {k: v for k, v in got.items() if k != 2000}


def test_repaired_turns_fit_the_audit(spark):
    rows = odd_rows()[:250]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    turns = C.damaged(frame)
    audits = {r["conv_id"]: r for r in C.audits(turns, live=turns["live"]).collect()}
    edits = C.repaired_turns(turns, live=turns["live"]).orderBy("conv_id", "place").collect()
    for conv, audit in audits.items():
        own = [e for e in edits if e["conv_id"] == conv]
        assert "".join(e["edit"] for e in own) == audit["audit"] and [e["place"] for e in own] == list(range(len(own)))
        kept = [e for e in own if e["role"] is not None]
        assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in kept).encode()).hexdigest() == audit["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(e["role"][0] for e in kept))
        assert all(e["old_role"] is None and e["text"] == "" for e in own if e["edit"] == "I")
    assert C.repaired_turns(turns.limit(0)).collect() == []


def test_one_exchange_moves_the_texts(spark, small):
    frame = spark.read.parquet(f"{small}/conversations.parquet")
    plan = C.conversation_audits(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    got = sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, f"/root/testdata/{sf}").collect()))
    assert got == sorted(map(tuple, con.execute(ORACLES["op11_conversation_repair"]).fetchall()))
