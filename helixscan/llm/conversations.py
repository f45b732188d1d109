"""Cheapest repair of damaged conversations, by dynamic programming over a grammar of their symbols.

A row is one of nine symbols: its role's initial (system, user, assistant or another), in capitals if it is truncated, or ``x`` if it has to be deleted.
The states of a repair are what has been given out so far: nothing, a system row, a user row, an assistant row.  A symbol's transfer
matrix has, for each pair of states, the least cost and the ASCII-least audit of that cost; the product of two matrices adds costs, joins
audits and keeps the least.  (Audits of the same cost and symbols never begin with each other, since one more insertion costs more, so that the least
audit of a whole is made of least audits of its parts.)

Re-Pair finds the pairs of symbols that are frequent over all conversations and gives them symbols of their own, round by round; each
such rule gets one matrix, worked out bottom-up once and shared by all conversations, with ropes for its audits.

Conversations are cut into segments of bounded length in a distributed sort, so that one that holds a large part of all rows is
worked on by many tasks: segments give matrices, a scan over the segments' costs chooses the states between them.  The texts are shuffled once, for the hash, which
a task works out from a stream of sorted rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, system, user, assistant.  What may follow each, by initial.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Insertions after the last row, by state.
CLOSING = ("", "II", "I", "")
#: Symbols of a segment; rounds of pair counts, and rules that a round makes at most (a grammar of at most 48 rules, whatever the data).
SEGMENT, ROUNDS, RULES = 1024, 6, 8
TERMINALS = "xsuaoSUAO"
FIRST_RULE = 0x100
#: Results of symbol strings that a task remembers.
REMEMBERED = 50_000
#: Larger than any cost of a conversation.
NEVER = 1 << 60


# Costs and audits


class Rope:
    """A joined string that is made when it is asked for, and then shared."""

    __slots__ = ("left", "right", "made")

    def __init__(self, left: Rope | None, right: Rope | None, made: str | None = None):
        self.left, self.right, self.made = left, right, made

    def __str__(self) -> str:
        if self.made is None:
            self.made = str(self.left) + str(self.right)
        return self.made


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def inserted(state: int) -> int:
    """The state after one insertion; only users and assistants are inserted."""
    return ASSISTANT if state == USER else USER


def terminal(symbol: str) -> Matrix:
    """Any insertions, then one row's edit."""
    out: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(p: int, q: int, cost: int, audit: str) -> None:
        out[p, q] = min(out.get((p, q), (NEVER, "")), (cost, audit))

    for p in range(4):
        m, audit = p, ""
        for k in range(3):  # a third insertion comes back to a state already met
            offer(p, m, INSERT * k + DELETE, audit + "D")
            if symbol != "x":
                more = INSERT * k + (TRUNCATED if symbol.isupper() else 0)
                if (q := FOLLOWS[m].get(symbol.lower())) is not None:
                    offer(p, q, more + KEEP, audit + "K")
                offer(p, inserted(m), more + REROLE, audit + "R")
            m, audit = inserted(m), audit + "I"
    return {k: (cost, Rope(None, None, audit)) for k, (cost, audit) in out.items()}


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, m), (x, left) in a.items():
        for (n, q), (y, right) in b.items():
            if m == n:
                held = out.get((p, q))
                rope = Rope(left, right)
                if held is None or x + y < held[0] or x + y == held[0] and str(rope) < str(held[1]):
                    out[p, q] = x + y, rope
    return out


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """The transfer matrix of every symbol; rule number i is the pair ``rules[i]`` of earlier symbols."""
    out = {t: terminal(t) for t in TERMINALS}
    for i, (x, y) in enumerate(rules):
        out[chr(FIRST_RULE + i)] = product(out[x], out[y])
    return out


def compressed(symbols: str, rules: list[str]) -> str:
    for i, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(FIRST_RULE + i))
    return symbols


Reached = list[tuple[int, str] | None]


def reached(symbols: str, start: int, table: dict[str, Matrix]) -> Reached:
    """Cost and audit for each state in the end, from one at the start."""
    now: Reached = [None] * 4
    now[start] = 0, ""
    for s in symbols:
        new: Reached = [None] * 4
        for (p, q), (cost, rope) in table[s].items():
            if (held := now[p]) is not None:
                other, x = new[q], held[0] + cost
                if other is None or x < other[0] or x == other[0] and held[1] + str(rope) < other[1]:
                    new[q] = x, held[1] + str(rope)
        now = new
    return now


def closed(ends: Reached) -> tuple[int, str]:
    """Cost and audit of a conversation that ends here."""
    return min((end[0] + INSERT * len(more), end[1] + more) for end, more in zip(ends, CLOSING, strict=True) if end)


# Rows and their faults


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, digest, blank, cut`` of the rows after damage; nulls of role and text are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    told = F.rtrim("text", F.lit(SPACE))
    return rows.withColumns({"digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "blank": told == "", "cut": ~F.right(told, F.lit(1)).isin(".", "!", "?")})


def looked_up(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Left join on keys that are equal or both null."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in keys})
    return a.join(b, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys)), "left").drop(*(f"_{c}" for c in keys))


def faulty(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, turn, role, digest, initial, symbol, n`` and counts of faults: rows that are all alike are one; and the same rows before that, written.

    ``symbol`` is that of the first of them; the others are duplicates.  Whether a text of a role was there before is looked up by
    the first turn of each, which the tasks find before the shuffle, and that turn is a key of the join: a text that fills a conversation makes no hot key."""
    runs = written(rows.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("n")), "runs")
    first = runs.groupBy("conv_id", "role", "digest").agg(F.when(F.max(F.col("turn").isNull()), None).otherwise(F.min("turn")).alias("turn")).withColumn("first", F.lit(True))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    later = F.col("first").isNull()
    joined = looked_up(runs, first, "conv_id", "turn", "role", "digest").withColumn("later", later)
    gone = F.col("blank") | F.col("later")
    return joined.select(
        "conv_id", "turn", "role", "digest", initial.alias("initial"), F.when(gone, "x").when(F.col("cut"), F.upper(initial)).otherwise(initial).alias("symbol"), "n",
        F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"), F.when(F.col("blank"), 0).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1).alias("duplicate"), (~gone & F.col("cut")).cast("long").alias("truncated"),
    ), runs


SEGMENT_COLUMNS = "part int, segment long, whole boolean, symbols string, first string, last string, illegal long, blank long, duplicate long, truncated long"


def segments(runs: DataFrame) -> DataFrame:
    """Conversations in their order as segments of at most ``SEGMENT`` symbols, with the places and keys of rows that may stay.

    ``part, segment`` number the segments of all conversations in order; ``whole``: it is all of its conversation."""
    turn, conv = (runs.schema[c].dataType.simpleString() for c in ("turn", "conv_id"))
    ordered = runs.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, number = TaskContext.get().partitionId(), [], 0
        schema = None
        held: dict | None = None
        begun = True  # the first conversation may have begun in the partition before

        def opened(conv, cut: bool) -> dict:
            return {"conv_id": conv, "symbols": [], "size": 0, "first": None, "last": None, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "at": [], "turn": [], "role": [], "digest": [], "cut": cut}

        def close(whole: bool) -> None:
            nonlocal number
            made.append((held["conv_id"], part, number, whole, "".join(held["symbols"]), *(held[c] for c in ("first", "last", "illegal", "blank", "duplicate", "truncated", "at", "turn", "role", "digest"))))
            number += 1

        def given() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            made.clear()
            types = [schema.field("conv_id").type, pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(schema.field("turn").type), pa.list_(pa.string()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *(c.split()[0] for c in SEGMENT_COLUMNS.split(", ")), "at", "turns", "roles", "digests"])

        for batch in batches:
            schema = batch.schema
            for conv, t, role, digest, initial, symbol, n, blank, duplicate, truncated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "initial", "symbol", "n", "blank", "duplicate", "truncated")), strict=True):
                if held is None or held["conv_id"] != conv:
                    if held is not None:
                        close(not begun and not held["cut"])
                        begun = False
                    held = opened(conv, False)
                left, first = n, True
                while left:
                    if held["size"] == SEGMENT:
                        close(False)
                        held = opened(conv, True)
                    take = min(left, SEGMENT - held["size"])
                    if first and symbol != "x":
                        held["at"].append(held["size"])
                        held["turn"].append(t)
                        held["role"].append(role)
                        held["digest"].append(digest)
                    held["symbols"].append((symbol if first else "x") + "x" * (take - 1))
                    held["illegal"] += take - 1 + (held["last"] is not None and held["last"] + initial not in ("su", "ua", "au"))
                    held["first"], held["last"] = held["first"] or initial, initial
                    held["size"] += take
                    left, first = left - take, False
                held["blank"] += blank
                held["duplicate"] += duplicate
                held["truncated"] += truncated
                if len(made) >= 5000:
                    yield given()
        if held is not None:
            close(False)
            yield given()

    return ordered.mapInArrow(run, f"conv_id {conv}, {SEGMENT_COLUMNS}, at array<int>, turns array<{turn}>, roles array<string>, digests array<binary>")


# The grammar


def pair_counts(cut: DataFrame, rules: list[str]) -> dict[str, int]:
    """How often each pair of symbols stands side by side, without overlaps, over all segments; at most (9 + 48)² pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for symbols, n in Counter(batch.column("symbols").to_pylist()).items():
                symbols, before = compressed(symbols, rules), -2
                for i, pair in enumerate(zip(symbols, symbols[1:])):  # noqa: B905
                    if pair[0] != pair[1] or before != i - 1 or symbols[i - 1] != pair[0]:
                        found["".join(pair)] += n
                        before = i
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

    counts = cut.select("symbols").mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in counts.collect()}


def repaired_pairs(cut: DataFrame, rounds: int = ROUNDS, each: int = RULES) -> list[str]:
    """Re-Pair over all segments: each round counts pairs anew and makes rules of the most frequent ones that share no symbol."""
    rules: list[str] = []
    for _ in range(rounds):
        counts, used, new = pair_counts(cut, rules), set(), []
        for pair, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n > 1 and len(new) < each and not used & set(pair):
                new.append(pair)
                used |= set(pair)
        if not new:
            break
        rules += new
    return rules


# Repairs


def evaluated(cut: DataFrame, rules: list[str]) -> DataFrame:
    """Adds ``cost, audit`` to whole conversations; to other segments, by the states before and after (16 each): ``costs``, ``ranks`` (of
    the audits that begin in the same state) and ``audits``."""
    kept = [f.name for f in cut.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", cost long, audit string, costs array<long>, ranks array<int>, audits array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = matrices(rules)  # of at most 9 + 48 symbols
        seen: dict[str, tuple[int, str]] = {}
        for batch in batches:
            out: list[tuple] = []
            for symbols, whole in zip(batch.column("symbols").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                if whole:
                    if symbols not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[symbols] = closed(reached(compressed(symbols, rules), START, table))
                    out.append((*seen[symbols], None, None, None))
                    continue
                costs, ranks, audits = [], [], []
                for p in range(4):
                    ends = reached(compressed(symbols, rules), p, table)
                    order = sorted(e[1] for e in ends if e)
                    costs += [e[0] if e else NEVER for e in ends]
                    ranks += [order.index(e[1]) if e else 4 for e in ends]
                    audits += [e[1] if e else None for e in ends]
                out.append((None, None, costs, ranks, audits))
            types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*batch.schema.names, "cost", "audit", "costs", "ranks", "audits"])

    return cut.select(*kept).mapInArrow(run, schema)


def scanned(pieces: DataFrame) -> DataFrame:
    """``part, segment, begin, end, cost, between``: the states around each segment of conversations that have several, the
    cost of the conversation and illegal pairs between segments (in its first one's row).  A group has two short lists of numbers for 1024 rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "segment"], ignore_index=True)
        costs, ranks = (np.array(group[c].tolist()).reshape(-1, 4, 4) for c in ("costs", "ranks"))
        ahead = [np.array([INSERT * len(c) for c in CLOSING])]
        for m in costs[::-1]:
            ahead.append(np.minimum((m + ahead[-1]).min(1), NEVER))
        ahead.reverse()
        state, begin, end = START, [], []
        for k, m in enumerate(costs):
            _, _, q = min((m[state, q] + ahead[k + 1][q], ranks[k, state, q], q) for q in range(4))
            begin.append(state)
            end.append(q)
            state = q
        pairs = [a + b not in ("su", "ua", "au") for a, b in zip(group["last"][:-1], group["first"][1:], strict=True)]
        n = len(group)
        return pd.DataFrame({"part": group["part"], "segment": group["segment"], "begin": begin, "end": end, "cost": [int(ahead[0][START])] + [0] * (n - 1), "between": [sum(pairs)] + [0] * (n - 1), "closes": [False] * (n - 1) + [True]})

    return pieces.select("conv_id", "part", "segment", "costs", "ranks", "first", "last").groupBy("conv_id").applyInPandas(run, "part int, segment long, begin int, end int, cost long, between long, closes boolean")


def resolved(pieces: DataFrame) -> DataFrame:
    """Every segment with ``begin`` (the state before it), its ``audit`` and its share of the conversation's ``cost`` and ``illegal`` pairs."""
    shared = ("conv_id", "part", "segment", "symbols", "blank", "duplicate", "truncated", "at", "turns", "roles", "digests")
    alone = pieces.where("whole").select(*shared, "illegal", F.lit(START).alias("begin"), "cost", "audit")
    chosen = scanned(pieces.where("NOT whole"))
    closing = F.when(F.col("closes"), F.get(F.array(*map(F.lit, CLOSING)), F.col("end"))).otherwise("")
    parts = pieces.where("NOT whole").drop("cost", "audit").join(chosen, ["part", "segment"])
    audit = F.concat(F.get("audits", 4 * F.col("begin") + F.col("end")), closing)
    return alone.unionByName(parts.select(*shared, (F.col("illegal") + F.col("between")).alias("illegal"), "begin", "cost", audit.alias("audit")))


def edits(found: DataFrame) -> DataFrame:
    """``conv_id, tail, turn, role, digest, before, named``: rows that stay, with initials of rows inserted ``before`` them and their role in the end.

    Insertions after a segment's last row that stays are a row of their own, with ``tail``."""
    conv, turn = found.schema["conv_id"].dataType.simpleString(), found.schema["turns"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, symbols, at, turns, roles, digests, state, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "symbols", "at", "turns", "roles", "digests", "begin", "audit")), strict=True):
                key, place, i, before = dict(zip(at, range(len(at)), strict=True)), 0, 0, ""
                for letter in audit:
                    if letter == "I":
                        state = inserted(state)
                        before += "u" if state == USER else "a"
                        continue
                    if letter != "D":
                        place = key[i]
                        state = FOLLOWS[state][symbols[i].lower()] if letter == "K" else inserted(state)
                        rows.append((conv_id, False, turns[place], roles[place], digests[place], before, roles[place] if letter == "K" else NAMES[state]))
                        before = ""
                    i += 1
                if before:
                    rows.append((conv_id, True, None, "", b"", before, ""))
            types = [batch.schema.field("conv_id").type, pa.bool_(), batch.schema.field("turns").type.value_type, pa.string(), pa.binary(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "tail", "turn", "role", "digest", "before", "named"])

    own = found.select("conv_id", "symbols", "at", "turns", "roles", "digests", "begin", "audit")
    return own.mapInArrow(run, f"conv_id {conv}, tail boolean, turn {turn}, role string, digest binary, before string, named string")


def hashes(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the rows of a task, sorted, go by one at a time; an edit stands before the rows that it is about."""
    texts = rows.select("conv_id", F.lit(False).alias("tail"), "turn", "role", "digest", F.lit(1).alias("kind"), "text", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("named"))
    marks = edited.select("conv_id", "tail", "turn", "role", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "before", "named")
    order = ("conv_id", "tail", F.asc_nulls_first("turn"), "role", "digest", "kind")
    ordered = texts.unionByName(marks).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "tail", "kind", "text", "before", "named")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, empty, waits, kept = None, None, True, None, None

        def add(line: str) -> None:
            nonlocal empty
            state.update(line.encode() if empty else b"\n" + line.encode())
            empty = False

        for batch in batches:
            done, kept = [], batch.schema.field("conv_id").type
            for conv_id, tail, kind, text, before, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state, empty, waits = conv_id, hashlib.sha256(), True, None
                if kind == 0:
                    for x in before:
                        add("user:" if x == "u" else "assistant:")
                    waits = None if tail else named
                elif waits is not None:
                    add(f"{waits}:{text}")
                    waits = None
            yield batch_of(kept, done)
        if state is not None:
            yield batch_of(kept, [(now, state.hexdigest())])

    def batch_of(kind: pa.DataType, done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every conversation.

    Input: ``conv_id, turn, role, text``; other columns are ignored.  Nulls: role and text are one space, a null turn comes first, a null ``conv_id`` is a
    conversation of its own.  A role's initial is its first character, none for an empty role, which can't be kept then.  Rows of the same turn stand in the
    order of role, then of the text's SHA-256; rows that are all alike stand side by side, the first of them counts and the others are duplicates.
    Texts may be empty or very long: they are hashed as a stream.  An empty table gives an empty table."""
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    symbols, runs = faulty(rows)
    cut = written(segments(symbols), "segments")
    rules = repaired_pairs(cut)
    pieces = written(evaluated(cut, rules), "matrices")
    found = written(resolved(pieces), "repairs")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "segment", "audit"))), lambda x: x["audit"]), "")
    counts = found.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], joined.alias("audit"))
    gaps = runs.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    digests = hashes(rows, edits(found))
    out = conversations.select("conv_id").distinct()
    for other in (gaps, counts, digests):
        out = looked_up(out, other, "conv_id")
    empty = hashlib.sha256().hexdigest()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle() -> str:
    """Row by row: the least of (cost, audit) for each state, with the repaired text beside it."""
    byte = "CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(k, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END"
    crc = f"xor(list_reduce(range(0, 8 * length(k)), lambda crc, i: xor(xor(crc, {byte}) >> 1, CASE WHEN xor(crc, {byte}) % 2 = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295)"
    plus = lambda x, cost, letter, line: f"{{'c': {x}.c + {cost}, 's': {x}.s || '{letter}', 'r': {x}.r || {line}}}"
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    into = {
        "m2": least("q2", *(plus(x, 3, "I", user) for x in ("q0", "q1", "q3"))),
        "m3": least("q3", plus("q2", 3, "I", assistant), *(plus(x, 6, "II", f"{user} || {assistant}") for x in ("q0", "q1"))),
    }
    kept, cost = "chr(10) || role || ':' || x", "CASE WHEN trunc THEN 3 ELSE 0 END"
    stay = lambda x, initial, name: f"CASE WHEN gone THEN {plus(x, 100000000, '', repr(''))} WHEN initial = '{initial}' THEN {plus(x, cost, 'K', kept)} ELSE {plus(x, f'3 + {cost}', 'R', f'chr(10) || {name!r} || {chr(39)}:{chr(39)} || x')} END"
    dropped = lambda x: plus(x, 4, "D", "''")
    never = "{'c': CAST(100000000 AS BIGINT), 's': '', 'r': ''}"
    return f"""WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role_, coalesce(text, ' ') AS text_ FROM conversations),
hit AS (SELECT conv_id, turn, role_, text_, {crc} % 20 AS h FROM keyed),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role_ END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text_, '.!?', '') ELSE text_ END AS x FROM hit, (SELECT unnest([1, 2]) AS copy) c WHERE h <> 0 AND (copy = 1 OR h = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(x)) AS i, substr(role, 1, 1) AS initial, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told FROM rows_),
faults AS MATERIALIZED (SELECT *, told = '' AS blank, told <> '' AND row_number() OVER (PARTITION BY conv_id, role, x ORDER BY i) > 1 AS dup FROM placed),
marked AS MATERIALIZED (SELECT conv_id, i, role, x, initial, blank OR dup AS gone, NOT blank AND NOT dup AND right(told, 1) NOT IN ('.', '!', '?') AS trunc FROM faults),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 's': '', 'r': ''}} AS q0, {never} AS q1, {never} AS q2, {never} AS q3 FROM conversations
 UNION ALL SELECT conv_id, i, {dropped("q0")}, CASE WHEN initial = 's' THEN {least(dropped("q1"), stay("q0", "s", "system"))} ELSE {dropped("q1")} END,
  {least(dropped("m2"), *(stay(x, "u", "user") for x in ("q0", "q1", "m3")))}, {least(dropped("m3"), stay("m2", "a", "assistant"))}
  FROM (SELECT d.conv_id, m.i, m.role, m.x, m.initial, m.gone, m.trunc, d.q0, d.q1, {into["m2"]} AS m2, {into["m3"]} AS m3 FROM (SELECT * FROM dp) d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1) y),
ends AS (SELECT conv_id, {least("q0", plus("q1", 6, "II", f"{user} || {assistant}"), plus("q2", 3, "I", assistant), "q3")} AS e FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
pairs AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS p FROM placed) z WHERE p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
counts AS (SELECT f.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS INT)) AS blank, sum(CAST(dup AS INT)) AS duplicate FROM faults f GROUP BY f.conv_id),
cuts AS (SELECT conv_id, sum(CAST(trunc AS INT)) AS truncated FROM marked GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
 e.e.c AS cost, e.e.s AS audit, sha256(substr(e.e.r, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN cuts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM e.conv_id"""
