import hashlib
import itertools
import random
import re
import zlib

import numpy as np

from chronowarn.llm import conversations as cv
from chronowarn.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?\Z")
TEXT = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Sequential search over rows, states and insertions: cost, audit and repaired lines; rows are (role, text, fault)."""
    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    def inserted(front):
        for _ in range(3):
            for state, (cost, audit, lines) in list(front.items()):
                for name in ("user", "assistant"):
                    if (new := after(state, name[0])) is not None:
                        front[new] = min(front.get(new, (10**9,)), (cost + 5, audit + "I", lines + [name + ":"]))
        return front

    front = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in front.items():
            ways = [(state, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                price = 5 if fault == "truncated" else 0
                ways += [(after(state, role[:1]), price, "K", [f"{role}:{text}"])]
                ways += [(after(state, name[0]), price + 1, "R", [f"{name}:{text}"]) for name in ("user", "assistant")]
            for to, price, letter, said in ways:
                if to is not None:
                    new[to] = min(new.get(to, (10**9,)), (cost + price, audit + letter, lines + said))
        front = inserted(new)
    return min(front[s] for s in ("", "a") if s in front)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
        seen, told = set(), []
        for _, _, role, text in mine:
            chars = TEXT.findall(text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest(told)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(told, told[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(t[2] == f for t in told) for f in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def result(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_cheapest_equals_every_edit_string():
    rng = random.Random(1)
    for _ in range(25):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.choice([None, None, "truncated", "blank"])) for i in range(rng.randint(0, 4))]
        found = []
        for n in range(len(rows), len(rows) + 5):
            for letters in itertools.product("KRDI", repeat=n):
                if sum(x != "I" for x in letters) != len(rows):
                    continue
                for roles in itertools.product("ua", repeat=sum(x in "RI" for x in letters)):
                    cost, said, todo, new = 0, "", iter(rows), iter(roles)
                    for x in letters:
                        role, _, fault = next(todo) if x != "I" else ("", "", None)
                        if x != "D" and fault == "blank":
                            break
                        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[x] + (5 if fault == "truncated" and x != "D" else 0)
                        said += role[0] if x == "K" else next(new) if x in "RI" else ""
                    else:
                        if FORM.match(said):
                            found.append((cost, "".join(letters)))
        assert min(found) == cheapest(rows)[:2]
        symbols = [3 * "suat".index(r[0]) + {None: 0, "blank": 1, "truncated": 2}[f] for r, _, f in rows]
        row = [(0, ""), None, None, None]
        for s in symbols:
            row = cv.product([row], cv.row_matrix(s))[0]
        assert cv.best(row) == min(found)


def test_grammar_changes_no_product():
    rng = np.random.default_rng(3)
    seqs = [rng.choice([3, 6, 3, 6, 3, 6, 4, 8, 0, 9], rng.integers(1, 60)).tolist() for _ in range(200)] + [[3, 6] * 300, [3] * 77]
    flat = np.array([s for seq in seqs for s in (*seq, -1)])
    rules = []
    for _ in range(25):
        pair, n = min(cv.pair_counts(cv.compress(flat, rules)).items(), key=lambda x: (-x[1], x[0]))
        before = len(cv.compress(flat, rules))
        rules.append(pair)
        assert before - len(cv.compress(flat, rules)) == n
    matrices = cv.rule_matrices(rules)
    left = np.split(out := cv.compress(flat, rules), np.flatnonzero(out < 0) + 1)[:-1]
    assert len(out) < 0.6 * len(flat)
    for seq, short in zip(seqs, left):
        one, two = cv.row_matrix(seq[0]), None
        for s in seq[1:]:
            one = cv.product(one, cv.row_matrix(s))
        for s in short[:-1].tolist():
            two = matrices[s] if two is None else cv.product(two, matrices[s])
        assert cv._cells(one) == cv._cells(two)


def test_query_equals_brute_force_and_sql(spark, sql, sorted_rows):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op13_conversation_repair"](spark, SMALL)
    got = sorted_rows(df)
    assert result(df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == brute(rows)
    assert got == sql(ORACLES["op13_conversation_repair"])


def awkward_rows():
    rng = random.Random(9)
    rows = []
    for conv in (None, *range(40)):
        for _ in range(rng.randint(1, 12)):
            turn = rng.choice([None, *range(9)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "User", "admin"]),
                         rng.choice(["a b.", "why?", "cut off", "", " \n\t", None, "Ünï \U0001F600!", "end. \x0b ", "a:b\nc.", f"own {rng.random()}."])))
    rows += rows[:30]
    rows += [(900, i, ("user", "assistant")[i % 2], f"turn {i}" + (".", "")[i % 7 == 0]) for i in range(-3000, 6000)]     # one long conversation
    rows += [(901, None, "user", "x" * 200_000 + "."), (901, 1, "assistant", "y " * 50_000 + "!")]
    dropped = next(t for t in range(1000) if zlib.crc32(f"902:{t}".encode()) % 20 == 0)
    return rows + [(902, dropped, "user", "gone.")]


def test_awkward_rows_equal_brute_force(spark, monkeypatch):
    rows = awkward_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "1 as at", "2 as symbol", "'K' as edits").repartition(7)
    want = brute(rows)
    assert result(cv.repaired_conversations(df)) == want
    monkeypatch.setattr(cv, "BLOCK_BITS", 5)      # many blocks and several levels of pieces
    monkeypatch.setattr(cv, "FAN", 4)
    assert result(cv.repaired_conversations(df)) == want
    assert cv.repaired_conversations(df.where("false")).collect() == []


def test_repaired_turns_have_the_form(spark):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] < 900]
    found, edited = cv.repair(cv.damage(spark.createDataFrame(rows, SCHEMA)))
    turns = {}
    for r in cv.repaired_turns(edited).orderBy("conv", "place").collect():
        turns.setdefault(r["conv"], []).append(r)
    for conv in found.collect():
        mine = turns.get(conv["conv"], [])
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert FORM.match("".join(r["role"][0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == conv["repaired_sha256"]
