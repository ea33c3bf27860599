"""Repair of conversation structure by grammar-compressed dynamic programming.

Every row of a conversation is one of twelve symbols: the initial of its role (s, u, a or another) and what its fault
demands (nothing, deletion, or a price for staying).  The cheapest edits form a min-plus product of one 4 x 4 matrix per
row over the states of the wanted form ``(s?(ua)+)?``: nothing yet, system, user, assistant.  A cell holds a cost and
the least audit of that cost, so the product is associative and any stretch of rows has one matrix.

A Re-Pair grammar over the symbols of all conversations names the pairs that are frequent in the whole corpus.  Each
rule's matrix is the product of its two sides, made once, bottom-up, with audits as ropes that share the sides' ropes;
every conversation multiplies what is left of its symbols after the rules.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.llm import tokens
from chronowarn.llm.shared import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CLASSES = "sua?"                    # role initials; the last stands for every other one
FREE, DOOMED, PRICED = range(3)     # what a row's fault demands: nothing, deletion, TRUNCATED if it stays
SYMBOLS = 3 * len(CLASSES)
START, SYSTEM, USER, ASSISTANT = range(4)
BLOCK_BITS = 12                     # a block has at most 2 ** BLOCK_BITS consecutive rows of one conversation
FAN = 64                            # pieces of a conversation that are multiplied at once
RULES = 512                         # rules of the grammar at most; symbols that no rule names are multiplied one by one
GAIN = 0.01                         # share of the symbols that a round of pairs must save
MEMO = 1 << 16                      # different sequences whose products a task remembers at once
BLANKS = " \t\n\x0b\x0c\r"


# ---- damage ----

def damage(rows: DataFrame) -> DataFrame:
    """conv (text of conv_id; null: one space), turn, role, text of ``rows`` after damage by CRC-32 of ``conv_id:turn``.

    Null conv_id, turn, role and text count as one space in that text and in role and text.  Of the CRC modulo 20:
    0 drops the row, 1 empties its text, 2 removes every ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = rows.select(space("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    rows = rows.where("_kind <> 0").select(
        "conv", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with ``at``, a number that rises along conversation, turn (nulls first), role, text.

    Numbers of one conversation's rows are consecutive within a task.  Range partitions cut a conversation of any
    length, and rows that are equal are dealt by a number of their own; texts alike in 64 characters follow their hash.
    """
    rows = written(rows.withColumn("_own", F.monotonically_increasing_id()), "damaged")
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text"), F.col("_own")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """conv, at, turn, symbol and the first fault (blank, duplicate, truncated, or null) of every ordered row.

    A row is a duplicate unless it is the first of its conversation with its role and text.  The firsts are found by a
    grouped minimum and met again on ``at``, which no two rows share.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    slim = rows.select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), last.alias("last"), F.md5(F.concat_ws("\0", "role", "text")).alias("key"))
    firsts = slim.groupBy("conv", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    told = slim.join(firsts, "at", "left").select("conv", "at", "turn", "initial", fault.alias("fault"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, i in zip(CLASSES, range(3)) for x in (c, i)]), F.col("initial")), F.lit(3))
    need = F.when(F.col("fault").isin("blank", "duplicate"), DOOMED).when(F.col("fault") == "truncated", PRICED).otherwise(FREE)
    return told.select("conv", "at", "turn", "fault", (3 * kind + need).cast("int").alias("symbol"))


# ---- the min-plus matrices ----

def _leaves(rope):
    todo = [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            yield top
        else:
            todo.append(top[1])
            todo.append(top[0])


def _text(rope) -> str:
    return rope if isinstance(rope, str) else "".join(_leaves(rope))


def _join(a, b):
    if not a or not b:
        return a or b
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 64 else (a, b)


def _less(a, b) -> bool:
    """Whether rope ``a`` comes before ``b``; read only as far as they are equal."""
    if a is b:
        return False
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    xs, ys, x, y = _leaves(a), _leaves(b), "", ""
    while True:
        x, y = x or next(xs, ""), y or next(ys, "")
        n = min(len(x), len(y))
        if not n or x[:n] != y[:n]:
            return x < y
        x, y = x[n:], y[n:]


def product(a: list, b: list) -> list:
    """Min-plus product of matrices (or of a row and a matrix) of cells (cost, audit rope) or None.

    Audits of one cost never begin one another: letters other than I are as many as rows, and each I costs.  So the
    least audit of a product is made of least audits.
    """
    out = []
    for row in a:
        best = [None] * len(b[0])
        for cell, line in zip(row, b):
            if cell is None:
                continue
            for y, step in enumerate(line):
                if step is None:
                    continue
                cost, old = cell[0] + step[0], best[y]
                if old is None or cost < old[0]:
                    best[y] = (cost, _join(cell[1], step[1]))
                elif cost == old[0]:
                    audit = _join(cell[1], step[1])
                    if _less(audit, old[1]):
                        best[y] = (cost, audit)
        out.append(best)
    return out


def _matrix(cells) -> list:
    out = [[None] * 4 for _ in range(4)]
    for x, y, cost, audit in cells:
        if out[x][y] is None or (cost, audit) < out[x][y]:
            out[x][y] = (cost, audit)
    return out


_TO = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (START,)}
_STEP = _matrix([*[(x, x, 0, "") for x in range(4)], *[(x, y, INSERT, "I") for y in (USER, ASSISTANT) for x in _TO[y]]])
INSERTS = product(_STEP, _STEP)     # no state is further than two insertions from another


def row_matrix(symbol: int) -> list:
    """Insertions before a row and its own edit."""
    kind, need = divmod(symbol, 3)
    cells = [(x, x, DELETE, "D") for x in range(4)]
    if need != DOOMED:
        price = TRUNCATED if need == PRICED else 0
        kept = {0: SYSTEM, 1: USER, 2: ASSISTANT}.get(kind)
        cells += [(x, kept, KEEP + price, "K") for x in _TO.get(kept, ())]
        cells += [(x, y, REROLE + price, "R") for y in (USER, ASSISTANT) for x in _TO[y]]
    return product(INSERTS, _matrix(cells))


def rule_matrices(rules: list[tuple[int, int]]) -> list[list]:
    """Matrices of the symbols and of every rule, bottom-up."""
    out = [row_matrix(s) for s in range(SYMBOLS)]
    for x, y in rules:
        out.append(product(out[x], out[y]))
    return out


def best(row: list):
    """Cost and audit of the cheapest way from the start that ends well, of a row of cells after all rows."""
    ends = [c for c in (product([row], INSERTS)[0][y] for y in (START, ASSISTANT)) if c is not None]
    cost, audit = min((c[0], _text(c[1])) for c in ends)
    return cost, audit


# ---- Re-Pair ----

def _hits(flat: np.ndarray, x: int, y: int) -> np.ndarray:
    """Where pair (x, y) begins in ``flat``, without overlaps: from the left in a run of one symbol."""
    hit = (flat[:-1] == x) & (flat[1:] == y)
    return np.flatnonzero(hit & _even(flat)[:-1]) if x == y else np.flatnonzero(hit)


def _even(flat: np.ndarray) -> np.ndarray:
    """Whether a symbol stands at an even place of its run of equal symbols."""
    place = np.arange(len(flat))
    start = np.r_[True, flat[1:] != flat[:-1]]
    return (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0


def compress(flat: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """``flat`` (sequences with -1 behind each) after all rules, in order; rule k makes symbol ``SYMBOLS + k``."""
    for k, (x, y) in enumerate(rules):
        at = _hits(flat, x, y)
        if len(at):
            flat = flat.copy()
            flat[at] = SYMBOLS + k
            flat = np.delete(flat, at + 1)
    return flat


def pair_counts(flat: np.ndarray) -> Counter:
    """How often every pair could be replaced in ``flat``."""
    if len(flat) < 2:
        return Counter()
    x, y = flat[:-1].astype(np.int64), flat[1:].astype(np.int64)
    good = (x >= 0) & (y >= 0) & ((x != y) | _even(flat)[:-1])
    values, counts = np.unique(x[good] << 32 | y[good], return_counts=True)
    return Counter({(v >> 32, v & 0xFFFFFFFF): c for v, c in zip(values.tolist(), counts.tolist())})


def _flat(column: pa.Array) -> np.ndarray:
    """A list column as one array with -1 behind each list."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(np.int64)
    return np.insert(values, np.cumsum(sizes), -1)


def _count_pairs(rules):
    def run(batches):
        total, symbols = Counter(), 0
        for batch in tokens.pieces(batches):
            flat = compress(_flat(batch.column(0)), rules)
            symbols += int((flat >= 0).sum())
            total.update(pair_counts(flat))
        rows = [(-1, -1, symbols), *[(x, y, n) for (x, y), n in total.items()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], ["x", "y", "n"])
    return run


def learn_rules(blocks: DataFrame, most: int = RULES) -> list[tuple[int, int]]:
    """Re-Pair over the column ``symbols`` of all ``blocks``: the rules in the order in which they are made.

    A round counts every pair of the whole corpus in the tasks and turns the most frequent ones that share no symbol
    into rules at once; pairs without a common symbol do not touch each other's counts, so this is what one pair at a
    time would give.  It ends when a round saves less than ``GAIN`` of the symbols or at ``most`` rules: the grammar
    decides how much work is shared, never the result.
    """
    rules: list[tuple[int, int]] = []
    while len(rules) < most:
        counts = blocks.select("symbols").mapInArrow(_count_pairs(rules), "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.col("x") >= 0, F.desc("n"), "x", "y").limit(1 + most).toArrow().to_pylist()   # the first row counts symbols
        if not top or top[0]["n"] == 0:
            break
        used, new, saved = set(), [], 0
        for row in top[1:]:
            pair = (row["x"], row["y"])
            if row["n"] >= 2 and not used & set(pair) and len(rules) + len(new) < most:
                used |= set(pair)
                new.append(pair)
                saved += row["n"]
        if saved < GAIN * top[0]["n"]:
            break
        rules += new
    return rules


# ---- blocks, pieces and conversations ----

CELLS = "array<struct<x:int,y:int,cost:bigint,audit:string>>"
PIECE = f"conv string, at long, illegal long, head int, tail int, spans array<struct<at:bigint,n:bigint>>, cells {CELLS}"
_CELL = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SPAN = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
_PIECE = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("illegal", pa.int64()), ("head", pa.int32()), ("tail", pa.int32()), ("spans", _SPAN), ("cells", _CELL)])
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _cells(matrix) -> list[dict]:
    return [{"x": x, "y": y, "cost": c[0], "audit": _text(c[1])} for x, row in enumerate(matrix) for y, c in enumerate(row) if c is not None]


def _block_pieces(rules):
    """Blocks (conv, at, symbols) to pieces; equal sequences are multiplied once."""
    def run(batches):
        matrices, memo = rule_matrices(rules), {}
        legal = np.zeros((4, 4), bool)
        for x, y in LEGAL:
            legal[x, y] = True
        for batch in tokens.pieces(batches):
            column = batch.column(2)
            flat = compress(_flat(column), rules)
            ends = np.flatnonzero(flat < 0)
            parts = [flat[a:b] for a, b in zip(np.r_[0, ends[:-1] + 1], ends)] if len(ends) else []
            out = []
            for conv, at, raw, left in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column.to_pylist(), parts):
                cells = memo.get(key := left.tobytes())
                if cells is None:
                    todo = left.tolist()
                    matrix = matrices[todo[0]]
                    for s in todo[1:]:
                        matrix = product(matrix, matrices[s])
                    if len(memo) >= MEMO:
                        memo.clear()
                    cells = memo[key] = _cells(matrix)
                kinds = np.array(raw) // 3
                out.append({"conv": conv, "at": at, "illegal": int((~legal[kinds[:-1], kinds[1:]]).sum()), "head": int(kinds[0]), "tail": int(kinds[-1]),
                            "spans": [{"at": at, "n": len(raw)}], "cells": cells})
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
    return run


def _one_piece(conv, pieces) -> dict:
    """The piece that consecutive pieces of a conversation form."""
    pieces = sorted(pieces, key=lambda p: p["at"])
    first, matrix = pieces[0], None
    illegal = sum(p["illegal"] for p in pieces) + sum((p["tail"], q["head"]) not in LEGAL for p, q in zip(pieces, pieces[1:]))
    if len(pieces) == 1:
        return {"conv": conv, **first}
    for p in pieces:
        mine = _matrix([(c["x"], c["y"], c["cost"], c["audit"]) for c in p["cells"]])
        matrix = mine if matrix is None else product(matrix, mine)
    return {"conv": conv, "at": first["at"], "illegal": illegal, "head": first["head"], "tail": pieces[-1]["tail"],
            "spans": [s for p in pieces for s in p["spans"]], "cells": _cells(matrix)}


def _merge(batches):
    for batch in tokens.pieces(batches):
        yield pa.RecordBatch.from_pylist([_one_piece(c, p) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], schema=_PIECE)


def whole_pieces(pieces: DataFrame) -> DataFrame:
    """One piece per conversation.  Pieces are multiplied in order, ``FAN`` numbers at a time while any conversation has more."""
    shift = BLOCK_BITS
    fields = F.struct("at", "illegal", "head", "tail", "spans", "cells")
    while not pieces.groupBy("conv").count().where(F.col("count") > FAN).isEmpty():
        shift += FAN.bit_length() - 1
        near = pieces.groupBy("conv", F.shiftright("at", shift).alias("_near")).agg(F.collect_list(fields).alias("pieces"))
        pieces = written(near.select("conv", "pieces").mapInArrow(_merge, PIECE), "pieces")
    return pieces.groupBy("conv").agg(F.collect_list(fields).alias("pieces")).mapInArrow(_merge, PIECE)


def _solve(batches):
    for batch in tokens.pieces(batches):
        found = []
        for cells in batch.column(1).to_pylist():
            found.append(best(_matrix([(c["x"], c["y"], c["cost"], c["audit"]) for c in cells])[START]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string()),
                                          batch.column(2), batch.column(3)], ["conv", "cost", "audit", "illegal", "spans"])


def row_edits(audit: str) -> list[str]:
    """The letters of every row: insertions before it and its own edit; the last row also has those behind it."""
    out, start = [], 0
    for i, letter in enumerate(audit):
        if letter != "I":
            out.append(audit[start : i + 1])
            start = i + 1
    if out:
        out[-1] += audit[start:]
    return out


def _edits(batches):
    """One row per edited turn; at most 65,536 of them at a time."""
    for batch in tokens.pieces(batches):
        convs, ats, letters = [], [], []
        for conv, audit, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            edits = iter(row_edits(audit))
            for span in spans:
                for i in range(span["n"]):
                    convs.append(conv)
                    ats.append(span["at"] + i)
                    letters.append(next(edits))
                    if len(ats) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(convs), pa.array(ats), pa.array(letters)], ["conv", "at", "edits"])
                        convs, ats, letters = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(ats, pa.int64()), pa.array(letters, pa.string())], ["conv", "at", "edits"])


def repaired_lines(state: int, edits: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """(role, text) of what one row leaves, with those inserted around it, and the state after them."""
    lines = []
    for letter in edits:
        if letter == "D":
            continue
        if letter == "K":
            name = role
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            name = "assistant" if state == ASSISTANT else "user"
        lines.append((name, text if letter != "I" else ""))
    return state, lines


def _digests(batches):
    """SHA-256 of every conversation's repaired lines, in one pass over rows sorted by conversation and ``at``."""
    now, state, begun, running, edits = None, START, False, hashlib.sha256(), ""
    for batch in tokens.pieces(batches):
        out = []
        for conv, edit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if conv != now:
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, state, begun, running = conv, START, False, hashlib.sha256()
            if edit is not None:      # the edit of the row that follows
                edits = edit
                continue
            state, lines = repaired_lines(state, edits, role, text)
            for name, said in lines:
                running.update((("\n" if begun else "") + f"{name}:{said}").encode("utf-8", "surrogatepass"))
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], ["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["conv", "repaired_sha256"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and edits of ``rows`` (conv, turn, role, text), which are repaired as they are.

    The first table has conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; the second one
    row per turn: conv, at (order), role, text, edits (letters).
    """
    rows = in_order(rows)
    told = written(faults(rows), "faults")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    stats = told.groupBy("conv").agg(gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    blocks = told.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("rows"))
    blocks = written(blocks.select("conv", F.col("rows")[0]["at"].alias("at"), F.col("rows")["symbol"].alias("symbols")), "blocks")
    rules = learn_rules(blocks)
    pieces = written(blocks.mapInArrow(_block_pieces(rules), PIECE), "pieces")
    solved = whole_pieces(pieces).select("conv", "cells", "illegal", "spans").mapInArrow(
        _solve, "conv string, cost long, audit string, illegal long, spans array<struct<at:bigint,n:bigint>>")
    solved = written(solved, "solved")
    edits = solved.select("conv", "audit", "spans").mapInArrow(_edits, "conv string, at long, edits string")
    edits = edits.select("conv", "at", "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = rows.select("conv", "at", F.lit(None).cast("string").alias("edits"), "role", "text")
    both = edits.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "at", F.col("edits").isNull())
    hashes = both.select("conv", "edits", "role", "text").mapInArrow(_digests, "conv string, repaired_sha256 string")
    found = stats.join(solved.select("conv", "illegal", "cost", "audit"), "conv").join(hashes, "conv")
    return found, rows.select("conv", "at", "role", "text").join(edits.select("at", "edits"), "at")


def repaired_turns(edited: DataFrame) -> DataFrame:
    """The repaired conversations of the second table of ``repair``: conv, place (from 0), role, text."""
    def run(batches):
        now, state, place = None, START, 0
        for batch in tokens.pieces(batches):
            out = []
            for conv, role, text, edits in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if conv != now:
                    now, state, place = conv, START, 0
                state, lines = repaired_lines(state, edits, role, text)
                for name, said in lines:
                    out.append({"conv": conv, "place": place, "role": name, "text": said})
                    place += 1
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    rows = edited.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "role", "text", "edits")
    return rows.mapInArrow(run, "conv string, place long, role string, text string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text) after ``damage`` and repair.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.  gaps: turns that
    are missing between the least and the greatest (null turns do not count).  A row's first fault counts: blank (only
    white space), duplicate (role and text stood earlier), truncated (does not end in ``.``, ``!`` or ``?``).  illegal:
    neighbours whose role initials are not su, ua or au.  cost and audit: the cheapest edits (K, R, D, I) toward
    ``(s?(ua)+)?``, ties to the least audit.

    Null conv_ids are one conversation; null turns come first, equal turns by role and text.  Null role and text are one
    space (another role, and blank).  Repeated rows are duplicates.  A conversation that loses all rows has zeros, an
    empty audit and the hash of nothing.  Empty input gives no rows; extra columns are ignored.

    Blocks of a conversation of any length are multiplied in parallel; only its audit is one value, and its hash, which
    no order but the given one can make, is one pass that keeps no rows.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    found, _ = repair(damage(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = every.join(found, "conv", "left")
    return out.select("conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
