"""Conversation structure repair by alignment to an alternating grammar.

The roles of a sound conversation spell ``(s?(ua)+)?``: an optional system
turn, then user and assistant in turn.  A conversation's rows are aligned
with every feasible length of that string by Wagner and Fischer's table; the
incumbent's cost bounds how far a cell may lie from the diagonal (Ukkonen's
band), and of all cheapest alignments the one whose audit (the edits'
initials in order) is least in ASCII is traced back.  All lengths that end
with the same role share one table, counted from the end.

Edits: Keep 0, Rerole (to user or assistant) 1, Delete 2, Insert of an empty
user or assistant turn 5; a row that is blank or was seen earlier must go; a
truncated row that stays adds 5.

Distribution: equal rows of a turn are counted before anything moves; the
rows are dealt by ranges of (conversation, turn) and sorted within them, so a
conversation that holds a third of all rows lies in many tasks.  A task
repairs what lies whole inside it and has at most ``BLOCK`` different rows;
the rest is cut into blocks, each aligned from every entry state to every
exit state of the grammar.  Blocks meet by states, costs and ranks only (a few
numbers a block, streamed in order, back pointers kept); then the chosen
pieces are streamed once more for the audit and the digest, which a single
pass over a conversation's repaired text has to make.  Later sightings of a
text are found by a salted join with the first ones.

No audit of a block is a prefix of another of the same block (both consume
all its rows, and insertions belong to the row that they precede), so cheapest
audits of blocks concatenate to the cheapest audit of the whole.

Defined results: NULL text and role are one space, so is a NULL id or turn in
the damage key; rows of one conversation go by turn (NULLs first), then role
and text; a NULL conv_id is a conversation of its own; repeated rows are
duplicates.  A conversation without rows has zeros, an empty audit and the
digest of nothing.  ``gaps`` beyond a long is its largest value.  An empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

BLOCK = 64          # different rows that are aligned at once
SALTS = 16          # parts of the rows that may share one first sighting
SPACES = " \t\n\x0b\x0c\r"
LONG_MAX = 2 ** 63 - 1

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
# states of the grammar: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {"u": "user", "a": "assistant"}
#: what has to be inserted after the last row, by the state it leaves
ENDING = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
INF = 1 << 60


def wanted(exit_state: int, k: int) -> str:
    """The role initial that opens an alternating string of ``k`` ending in ``exit_state``."""
    return "a" if (k % 2 == 1) == (exit_state == ASSISTANT) else "u"


def lengths(entry: int, exit_state: int, top: int) -> range:
    """Feasible lengths of the alternating string between two states."""
    same = (entry == USER) == (exit_state == USER)     # the string's first role follows from its length
    return range(2 if same else 1, top + 1, 2)


def _stay(item, c: str) -> int:
    """Cost of keeping or reroling a row as ``c``."""
    return item[2] + (0 if item[1] == c else REROLE)


def incumbent(free: list, exit_state: int) -> int:
    """Cost of a plain alignment (some first or last rows deleted, the others
    matched one to one), whichever state the string is entered from."""
    worst = 0
    for parity in (0, 1):
        best = (DELETE + CUT_OFF + INSERT) * (len(free) + 2)
        for skip in range(min(3, len(free))):
            for n in (len(free) - skip, len(free) - skip - 1):
                if n > 0 and n % 2 == parity:
                    cost = DELETE * (len(free) - n) + sum(_stay(x, wanted(exit_state, n - i))
                                                          for i, x in enumerate(free[skip:skip + n]))
                    best = min(best, cost)
        worst = max(worst, best)
    return worst


def tail_table(items: list, exit_state: int, bound: int) -> list[list[int]]:
    """``table[i][k]``: cheapest alignment of the rows from ``i`` on with an
    alternating string of ``k`` that ends in ``exit_state``; nothing is
    inserted after the last row.  Cells outside the bound's band stay INF."""
    n = len(items)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (not items[i][0])
    top = left[0] + bound // INSERT if n else 0
    table = [[INF] * (top + 1) for _ in range(n + 1)]
    table[n][0] = 0
    for i in range(n - 1, -1, -1):
        item, below, row = items[i], table[i + 1], table[i]
        lo, hi = max(0, left[i] - bound // DELETE), min(top, left[i] + bound // INSERT)
        forced = item[0]
        for k in range(lo, hi + 1):
            best = below[k] if forced else below[k] + DELETE
            if k:
                if not forced:
                    best = min(best, below[k - 1] + _stay(item, wanted(exit_state, k)))
                best = min(best, row[k - 1] + INSERT)
            row[k] = best if best < INF else INF
    return table


def trace(items: list, table: list[list[int]], exit_state: int, i: int, k: int) -> str:
    """The least audit of the cheapest alignment from a cell on."""
    out = []
    while i < len(items):
        item, here, below = items[i], table[i][k], table[i + 1]
        if below[k] + (0 if item[0] else DELETE) == here:
            out.append("D")
            i += 1
        elif k and table[i][k - 1] + INSERT == here:
            out.append("I")
            k -= 1
        else:
            out.append("K" if item[1] == wanted(exit_state, k) else "R")
            i, k = i + 1, k - 1
    return "".join(out)


def align_block(items: list) -> dict[tuple[int, int], tuple[int, str]]:
    """``(entry, exit) -> (cost, least cheapest audit)`` of a block of rows
    ``(must go, role initial, cost of staying)``; forced deletions are not in the cost."""
    free = [x for x in items if not x[0]]
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(key, cost, audit):
        if cost < INF and (key not in found or (cost, audit()) < found[key]):
            found[key] = (cost, audit())

    for state in range(4):
        found[(state, state)] = (DELETE * len(free), "D" * len(items))
    for last in (USER, ASSISTANT):
        table = tail_table(items, last, incumbent(free, last))
        top = len(table[0]) - 1
        for entry in range(4):
            for k in lengths(entry, last, top):
                if table[0][k] <= found.get((entry, last), (INF,))[0]:
                    offer((entry, last), table[0][k], lambda: trace(items, table, last, 0, k))
        # a system turn first: rows before it are deleted, then the tail follows
        before = 0
        for i, item in enumerate(items):
            if not item[0] and item[1] == "s":
                for k in lengths(SYSTEM, last, top):
                    cost = before + item[2] + table[i + 1][k]
                    if cost <= found.get((START, last), (INF,))[0]:
                        offer((START, last), cost, lambda: "D" * i + "K" + trace(items, table, last, i + 1, k))
                cost = before + item[2] + DELETE * (len(free) - before // DELETE - 1)
                if last == USER:
                    offer((START, SYSTEM), cost, lambda: "D" * i + "K" + "D" * (len(items) - i - 1))
            before += 0 if item[0] else DELETE
    return found


def flat(found: dict) -> tuple[list, list, list]:
    """Costs, ranks among the audits of the same entry, and audits, by entry * 4 + exit."""
    costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
    for entry in range(4):
        own = sorted((audit, state) for (e, state), (_, audit) in found.items() if e == entry)
        for rank, (audit, state) in enumerate(own):
            costs[entry * 4 + state], ranks[entry * 4 + state], audits[entry * 4 + state] = found[(entry, state)][0], rank, audit
    return costs, ranks, audits


def advance(best: dict, costs: list, ranks: list) -> tuple[dict, list]:
    """One block further: ``state -> (cost, rank)`` and each state's predecessor."""
    ahead, back = {}, [None] * 4
    for state in range(4):
        options = [(c + costs[p * 4 + state], r, ranks[p * 4 + state], p) for p, (c, r) in best.items()
                   if costs[p * 4 + state] is not None]
        if options:
            ahead[state] = min(options)
            back[state] = ahead[state][3]
    order = sorted(ahead, key=lambda s: ahead[s][1:3])
    return {s: (ahead[s][0], order.index(s)) for s in ahead}, back


def finish(best: dict) -> tuple[int, int]:
    """Cheapest state to end in, with the insertions that it needs: (state, cost)."""
    cost, _, state = min((c + INSERT * len(ENDING[s]), r, s) for s, (c, r) in best.items())
    return state, cost


def repaired(audit: str, roles: list, texts: list, state: int) -> tuple[list[str], int]:
    """Lines of a block's repaired rows, and the state after them."""
    lines, j = [], 0
    for edit in audit:
        if edit in "KRI":
            if edit == "K" and state == START and roles[j][:1] == "s":
                initial = "s"
            else:
                initial = "a" if state == USER else "u"
            role = roles[j] if edit == "K" else ROLE[initial]
            lines.append(f"{role}:{'' if edit == 'I' else texts[j]}")
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
        j += edit != "I"
    return lines, state


def with_copies(audit: str, copies: list) -> str:
    """The audit with the deletions of a row's copies behind the row's own edit."""
    out, j = [], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            out.append("D" * (copies[j] - 1))
            j += 1
    return "".join(out)


COUNTS = ["blank", "duplicate", "truncated", "illegal", "forced"]
STATS = [("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()),
         *[(c, pa.int64()) for c in COUNTS]]


class _Rows:
    """The rows of one conversation read so far, within one block."""

    def __init__(self):
        self.items, self.roles, self.texts, self.copies = [], [], [], []
        self.low = self.high = self.first = self.last = None
        self.turns = 0
        self.n = dict.fromkeys(COUNTS, 0)

    def add(self, turn, role, text, copies, blank, seen, cut):
        initial = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.last is None:
            self.first = initial
        else:
            self.n["illegal"] += self.last + initial not in LEGAL
        self.n["illegal"] += copies - 1            # a role never follows itself
        self.last = initial
        gone = blank or seen
        self.n["blank"] += copies if blank else 0
        self.n["duplicate"] += 0 if blank else copies if seen else copies - 1
        self.n["truncated"] += 0 if gone else cut
        self.n["forced"] += copies if gone else copies - 1
        self.items.append((gone, initial, CUT_OFF if cut else 0))
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.copies.append(copies)

    def stats(self) -> dict:
        return {"low": self.low, "high": self.high, "turns": self.turns, "first": self.first, "last": self.last, **self.n}


def _gaps(low, high, turns) -> int:
    return 0 if low is None else min(high - low + 1 - turns, LONG_MAX)


def _answer(conv, s: dict, cost: int, audit: str, digest: str) -> dict:
    return {"conv_id": conv, "gaps": _gaps(s["low"], s["high"], s["turns"]), "cost": cost + DELETE * s["forced"], "audit": audit,
            "repaired_sha256": digest, **{c: s[c] for c in COUNTS[:4]}}


def _whole(conv, rows: _Rows) -> dict:
    """Repair of a conversation that lies in one block."""
    if not rows.items:
        return _answer(conv, rows.stats(), 0, "", hashlib.sha256().hexdigest())
    found = align_block(rows.items)
    costs, ranks, audits = flat(found)
    best, _ = advance({START: (0, 0)}, costs, ranks)
    state, cost = finish(best)
    lines, _ = repaired(audits[state], rows.roles, rows.texts, START)
    lines += [f"{ROLE[c]}:" for c in ENDING[state]]
    return _answer(conv, rows.stats(), cost, with_copies(audits[state], rows.copies) + "I" * len(ENDING[state]),
                   hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())


def _spark_type(t: pa.DataType) -> str:
    return {pa.int64(): "long", pa.string(): "string"}[t]


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
RESULT_COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _read(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield from batch.slice(start, size).to_pylist()


def _write(rows: Iterator[dict], schema: pa.Schema, size: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches bounded in rows and in the characters that they hold."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += sum(map(len, r.get("texts") or ())) + len(r.get("audit") or "")
        if len(held) >= size or weight >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _local(block: int, schema: pa.Schema):
    """Per sorted range of rows: whole conversations repaired, the others as blocks."""

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()

        def blocks(conv, idx, rows):
            costs, ranks, audits = flat(align_block(rows.items))
            return {"conv_id": conv, "part": part, "idx": idx, "costs": costs, "ranks": ranks, "audits": audits,
                    "roles": rows.roles, "texts": rows.texts, "copies": rows.copies, **{f"b_{k}": v for k, v in rows.stats().items()}}

        def out():
            conv = rows = None
            begun, first, idx = False, True, 0
            for r in _read(batches):
                if not begun or r["conv_id"] != conv:
                    if begun:
                        if first or idx:
                            yield blocks(conv, idx, rows)
                        else:
                            yield {"part": None} | _whole(conv, rows)
                        first = False
                    conv, rows, idx, begun = r["conv_id"], _Rows(), 0, True
                if r["copies"]:
                    if len(rows.items) >= block:
                        yield blocks(conv, idx, rows)
                        rows, idx = _Rows(), idx + 1
                    rows.add(r["turn"], r["role"], r["text"], r["copies"], r["blank"], r["seen"], r["cut"])
            if begun:
                yield blocks(conv, idx, rows)

        yield from _write(out(), schema)
    return run


def _choose(schema: pa.Schema):
    """Blocks of whole conversations, in order -> entry and exit state of each."""

    def run(batches):
        def close(conv, keys, backs, best):
            state, cost = finish(best)
            ending = ENDING[state]
            for j in range(len(keys) - 1, -1, -1):
                entry = backs[j][state]
                yield {"conv_id": conv, "part": keys[j][0], "idx": keys[j][1], "entry": entry, "exit": state,
                       "ending": ending if j == len(keys) - 1 else "", "total": cost}
                state = entry

        def out():
            conv, keys, backs, best = None, [], [], {START: (0, 0)}
            for r in _read(batches):
                if keys and r["conv_id"] != conv:
                    yield from close(conv, keys, backs, best)
                    keys, backs, best = [], [], {START: (0, 0)}
                conv = r["conv_id"]
                best, back = advance(best, r["costs"], r["ranks"])
                keys.append((r["part"], r["idx"]))
                backs.append(bytes(4 if b is None else b for b in back))
            if keys:
                yield from close(conv, keys, backs, best)

        yield from _write(out(), schema)
    return run


def _assemble(schema: pa.Schema):
    """Chosen blocks, in order -> one row a conversation (the text is only streamed)."""

    def run(batches):
        def out():
            conv, s, audit, digest, state, cost, lines_seen = None, None, [], None, START, 0, False
            for r in _read(batches):
                if s is not None and r["conv_id"] != conv:
                    yield _answer(conv, s, cost, "".join(audit), digest.hexdigest())
                    s = None
                mine = {k: r[f"b_{k}"] for k, _ in STATS}
                if s is None:
                    conv, s, audit, digest, state, lines_seen = r["conv_id"], mine, [], hashlib.sha256(), START, False
                else:
                    s["turns"] += mine["turns"] - (mine["low"] is not None and mine["low"] == s["high"])
                    s["illegal"] += s["last"] is not None and mine["first"] is not None and s["last"] + mine["first"] not in LEGAL
                    for c in COUNTS:
                        s[c] += mine[c]
                    s["low"] = mine["low"] if s["low"] is None else s["low"]
                    s["high"] = s["high"] if mine["high"] is None else mine["high"]
                    s["last"] = s["last"] if mine["last"] is None else mine["last"]
                cost = r["total"]
                lines, state = repaired(r["audit"], r["roles"], r["texts"], state)
                lines += [f"{ROLE[c]}:" for c in r["ending"]]
                audit.append(with_copies(r["audit"], r["copies"]) + "I" * len(r["ending"]))
                for line in lines:
                    digest.update((("\n" if lines_seen else "") + line).encode("utf-8", "surrogatepass"))
                    lines_seen = True
            if s is not None:
                yield _answer(conv, s, cost, "".join(audit), digest.hexdigest())

        yield from _write(out(), schema)
    return run


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``: drop (no copies),
    empty, strip of sentence ends, repeat (two copies), role user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), kind.alias("kind"), role.alias("role"),
                                text.alias("text")).select(
        "conv_id", "turn",
        F.when(F.col("kind") != 0, F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        F.when(F.col("kind") != 0, F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
               .otherwise(F.col("text"))).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Different rows with their copies and faults (``rows``: conv_id, turn,
    role, text, copies; zero copies: a row that only names its conversation)."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    there = F.col("copies") > 0
    d = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).select(
        "*", (there & (trimmed == "")).alias("blank"), (there & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(there, F.unhex(F.md5(F.concat("role", F.lit("\n"), "text").cast("binary")))).alias("key"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at")).alias("when"))
    again = (d.where(there & ~F.col("blank")).groupBy("conv_id", "key")
             .agg(F.count(F.lit(1)).alias("n"), F.min("when").alias("earliest")).where("n > 1")
             .select(F.col("conv_id").alias("c2"), F.col("key").alias("k2"), "earliest",
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s2")))
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")
    j = d.withColumn("salt", salt).join(again, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("key") == F.col("k2"))
                                        & (F.col("salt") == F.col("s2")), "left")
    return j.select("conv_id", "turn", "role", "text", "copies", F.coalesce("blank", F.lit(False)).alias("blank"),
                    F.coalesce(F.col("when") > F.col("earliest"), F.lit(False)).alias("seen"),
                    F.coalesce("cut", F.lit(False)).alias("cut"))


def _in_order(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *keys)


def repair(rows: DataFrame, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """Audit and digest of every conversation's cheapest repair.

    ``rows``: conv_id, turn, role, text, copies (``damage`` makes them of a
    table; without damage, copies are 1)."""
    ident = rows.schema["conv_id"].dataType.simpleString()
    arrow_id = pa.int64() if ident == "bigint" else pa.int32() if ident == "int" else pa.string()
    base = cut_lineage(faults(rows))
    near = F.substring("text", 1, 32)      # a coarser order than the text's, so that bounds stay short
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), near]
    dealt = base.repartitionByRange(partitions, *keys) if partitions else base.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    results = pa.schema([("conv_id", arrow_id), *[(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64())
                                                  for c in RESULT_COLUMNS]])
    sixteen = [("costs", "array<long>", pa.list_(pa.int64())), ("ranks", "array<long>", pa.list_(pa.int64())),
               ("audits", "array<string>", pa.list_(pa.string())), ("roles", "array<string>", pa.list_(pa.string())),
               ("texts", "array<string>", pa.list_(pa.string())), ("copies", "array<long>", pa.list_(pa.int64()))]
    full = pa.schema([*results, ("part", pa.int32()), ("idx", pa.int32()), *[(n, t) for n, _, t in sixteen],
                      *[(f"b_{n}", t) for n, t in STATS]])
    full_sql = (f"conv_id {ident}, {RESULT}, part int, idx int, " + ", ".join(f"{n} {t}" for n, t, _ in sixteen) + ", "
                + ", ".join(f"b_{n} {_spark_type(t)}" for n, t in STATS))
    local = cut_lineage(dealt.mapInArrow(_local(block, full), full_sql))
    open_ = local.where("part IS NOT NULL")
    choice_sql = f"conv_id {ident}, part int, idx int, entry int, exit int, ending string, total long"
    choice_arrow = pa.schema([("conv_id", arrow_id), ("part", pa.int32()), ("idx", pa.int32()), ("entry", pa.int32()),
                              ("exit", pa.int32()), ("ending", pa.string()), ("total", pa.int64())])
    choice = (_in_order(open_.select("conv_id", "part", "idx", "costs", "ranks"), "part", "idx")
              .mapInArrow(_choose(choice_arrow), choice_sql)
              .select(F.col("part").alias("p2"), F.col("idx").alias("i2"), F.col("conv_id").alias("c2"), "entry", "exit", "ending", "total"))
    pieces = open_.join(choice, (F.col("part") == F.col("p2")) & (F.col("idx") == F.col("i2")) & F.col("conv_id").eqNullSafe(F.col("c2")))
    pieces = pieces.select("conv_id", "part", "idx", F.get("audits", F.col("entry") * 4 + F.col("exit")).alias("audit"), "roles", "texts",
                           "copies", "ending", "total", *[f"b_{n}" for n, _ in STATS])
    joined = _in_order(pieces, "part", "idx").mapInArrow(_assemble(results), f"conv_id {ident}, {RESULT}")
    return local.where("part IS NULL").select("conv_id", *RESULT_COLUMNS).unionByName(joined)


def op13_turns(conversations: DataFrame) -> DataFrame:
    """Damage and repair of all conversations."""
    return repair(damage(conversations))
