"""Repair of conversation structure by lazy weighted determinisation.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. What it costs to finish from each of the
four places in that pattern is a vector; less its smallest entry it is a state of a weighted automaton
over turns read from last to first. States and transitions are made when first met and
kept in a table, so a conversation costs one look-up a turn. The way back, from first turn to last, follows
arcs whose costs are tight, the ASCII-least letter first, which gives the audit.

Turns are sorted once into ranges of bounded size. A conversation that lies in one range is settled
there; pieces of one that spans ranges are min-plus matrices, chained from the last piece to the first, so that a
conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches, sorted_ranges

#: Turns of a range of the order.
RANGE = 1 << 16
WHITE = " \t\n\x0b\x0c\r"
CLASSES = "sua"  # role initials; 3 is any other
DELETE, INSERT, REROLE, OPEN = 2, 5, 1, 5  # costs; OPEN: a truncated turn that stays
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
# places in the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end at 0 and 3
KEPT = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
WANTED, AFTER = (1, 1, 2, 1), (2, 2, 3, 2)
ROLE = {1: "user", 2: "assistant"}


def closed(v: list[float]) -> list[float]:
    """Costs with turns inserted first where that is cheaper."""
    for _ in range(2):
        v = [min(v[q], INSERT + v[AFTER[q]]) for q in range(4)]
    return v


#: Costs to finish behind the last turn.
END = tuple(closed([0, inf, inf, 0]))


class Automaton:
    """States (vectors less their least entry), transitions by (state, symbol), and tight arcs by the same; all made on demand."""

    def __init__(self) -> None:
        self.vectors: list[tuple[float, ...]] = []
        self.known: dict[tuple[float, ...], int] = {}
        self.table: list[list[tuple[int, float] | None]] = []
        self.arcs: dict[tuple[int, int], list[tuple[str, int] | None]] = {}

    def state(self, v: list[float]) -> tuple[int, float]:
        least = min(v)
        own = tuple(x - least for x in v)
        if own not in self.known:
            self.known[own] = len(self.vectors)
            self.vectors.append(own)
            self.table.append([None] * 12)
        return self.known[own], least

    @staticmethod
    def choices(q: int, symbol: int) -> list[tuple[str, float, int]]:
        """What can be done with a turn at place q: letter, cost, next place."""
        kind, fault = divmod(symbol, 3)
        out = [("D", DELETE, q)]
        if fault != 2:
            stays = OPEN if fault == 1 else 0
            if kind in KEPT[q]:
                out.append(("K", stays, KEPT[q][kind]))
            out.append(("R", stays + REROLE, AFTER[q]))
        return out

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        """Put a turn in front."""
        found = self.table[state][symbol]
        if found is None:
            v = self.vectors[state]
            found = self.table[state][symbol] = self.state(closed([min(cost + v[to] for _, cost, to in self.choices(q, symbol)) for q in range(4)]))
        return found

    def scan(self, symbols: list[int], v: tuple[float, ...] | list[float]) -> tuple[list[int], list[float]]:
        """States before each turn and behind the last, and the vector in front."""
        state, total = self.state(list(v))
        path = [state]
        table = self.table
        for symbol in reversed(symbols):
            state, more = table[state][symbol] or self.step(state, symbol)
            total += more
            path.append(state)
        path.reverse()
        return path, [x + total for x in self.vectors[state]]

    def tight(self, behind: int, symbol: int) -> list[tuple[str, int] | None]:
        """For each place, the least letters up to and with this turn that cost no more than they must, and the place behind it."""
        found = self.arcs.get((behind, symbol))
        if found is None:
            (front, more), after = self.step(behind, symbol), self.vectors[behind]
            v = self.vectors[front]
            found = []
            for start in range(4):
                letters, q = "", start
                while v[q] < inf:
                    arcs = [(letter, to) for letter, cost, to in self.choices(q, symbol) if v[q] + more == cost + after[to]]
                    if v[q] == INSERT + v[AFTER[q]]:
                        arcs.append(("I", q))
                    letter, to = min(arcs)
                    letters += letter
                    if letter != "I":
                        found.append((letters, to))
                        break
                    q = AFTER[q]
                else:
                    found.append(None)
            self.arcs[behind, symbol] = found
        return found

    def trace(self, symbols: list[int], path: list[int], q: int, last: bool) -> tuple[str, int]:
        """Letters of a piece entered at place q, and the place behind it."""
        out = []
        for i, symbol in enumerate(symbols):
            letters, q = self.tight(path[i + 1], symbol)[q]
            out.append(letters)
        while last and q in (1, 2):
            out.append("I")
            q = AFTER[q]
        return "".join(out), q


#: One table a Python worker, grown by all conversations it meets.
AUTOMATON = Automaton()


def legal(before: int, after: int) -> bool:
    return (before, after) in ((0, 1), (1, 2), (2, 1))


PIECE = "grp string, part int, edge boolean, first boolean, last boolean, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head int, tail int, cost double, matrix array<double>, behind array<double>, turn long, role string, hash string, copy int"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def as_table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema([(n, _KINDS[t]) for n, t in (c.split(" ") for c in schema.split(", "))]))


def runs(rows: pa.Table) -> list[tuple[int, int]]:
    """Bounds of the conversations in sorted rows."""
    names = rows["grp"].to_pylist()
    cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def pieces(rows: pa.Table) -> pa.Table:
    """One row for each conversation of a range: its counts, and its costs for every place before and behind."""
    rows = rows.sort_by("idx")
    symbols, faults, kinds, turns = (rows[c].to_pylist() for c in ("symbol", "fault", "kind", "turn"))
    out = []
    for a, b in runs(rows):
        read = symbols[a:b]
        unit = [AUTOMATON.scan(read, [0 if e == x else inf for x in range(4)])[1] for e in range(4)]
        given = [t for t in turns[a:b] if t is not None]
        first = {c: rows[c][a].as_py() for c in ("grp", "part", "turn", "role", "hash", "copy")}
        out.append(first | {
            "edge": a == 0 or b == len(symbols), "first": True, "last": True, "blank": faults[a:b].count(BLANK), "duplicate": faults[a:b].count(DUPLICATE), "truncated": faults[a:b].count(TRUNCATED),
            "illegal": sum(not legal(x, y) for x, y in zip(kinds[a : b - 1], kinds[a + 1 : b], strict=True)), "turns": len(set(given)), "low": given[0] if given else None, "high": given[-1] if given else None,
            "head": kinds[a], "tail": kinds[b - 1], "cost": AUTOMATON.scan(read, END)[1][0], "matrix": [unit[e][q] for q in range(4) for e in range(4)], "behind": list(END),
        })
    return as_table(out, PIECE)


def chain(rows: pa.Table) -> pa.Table:
    """The pieces of one conversation, with the costs behind each and counts mended where pieces meet."""
    out = rows.sort_by("part").to_pylist()
    behind = list(END)
    for r in reversed(out):
        r["behind"] = behind
        behind = [min(r["matrix"][4 * q + e] + r["behind"][e] for e in range(4)) for q in range(4)]
    out[0]["cost"] = behind[0]
    for before, r in zip(out[:-1], out[1:], strict=True):
        before["last"], r["first"], r["cost"] = False, False, 0.0
        r["illegal"] += not legal(before["tail"], r["head"])
        r["turns"] -= before["high"] is not None and before["high"] == r["turn"]
    return as_table(out, PIECE)


TRACE = "grp string, part int, edge boolean, first boolean, entry int, exit int, audit string"


def traces(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Audits of the pieces of a range, for every place a piece may be entered at."""
    rows = rows.sort_by("idx")
    symbols = rows["symbol"].to_pylist()
    of = {r["grp"]: r for r in found.select(["grp", "part", "edge", "first", "last", "behind"]).to_pylist()}
    out = []
    for a, b in runs(rows):
        r = of[rows["grp"][a].as_py()]
        path, front = AUTOMATON.scan(symbols[a:b], r["behind"])
        for q in [0] if r["first"] else range(4):
            if front[q] < inf:
                audit, to = AUTOMATON.trace(symbols[a:b], path, q, r["last"])
                out.append({"grp": r["grp"], "part": r["part"], "edge": r["edge"], "first": r["first"], "entry": q, "exit": to, "audit": audit})
    return as_table(out, TRACE)


def follow(rows: pa.Table) -> pa.Table:
    """Of the traces of one conversation those that follow one another."""
    out, q, part = [], 0, None
    for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
        if r["part"] != part and r["entry"] == q:
            out.append(r)
            part, q = r["part"], r["exit"]
    return as_table(out, TRACE)


def digests(rows: DataFrame) -> DataFrame:
    """(grp, repaired_sha256) from turns and audits in order: (grp, mark, role, text), an audit standing before the turns it is about.

    One turn and the letters of a piece are held at a time; the digest of one conversation is read in one task, as it must be.
    """
    small_batches(rows.sparkSession)

    class Reader:
        def __init__(self, grp: str) -> None:
            self.grp, self.letters, self.q, self.hash, self.some = grp, deque(), 0, hashlib.sha256(), False

        def put(self, role: str, text: str) -> None:
            self.hash.update(("\n" * self.some + role + ":" + text).encode())
            self.some = True

        def inserts(self) -> None:
            while self.letters and self.letters[0] == "I":
                self.letters.popleft()
                self.put(ROLE[WANTED[self.q]], "")
                self.q = AFTER[self.q]

        def turn(self, role: str, text: str) -> None:
            self.inserts()
            letter = self.letters.popleft()
            if letter == "K":
                self.put(role, text)
                self.q = KEPT[self.q][CLASSES.index(role[0])]
            elif letter == "R":
                self.put(ROLE[WANTED[self.q]], text)
                self.q = AFTER[self.q]

        def end(self) -> tuple[str, str]:
            self.inserts()
            return self.grp, self.hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for grp, mark, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or grp != now.grp:
                    if now is not None:
                        done.append(now.end())
                    now = Reader(grp)
                if mark is None:
                    now.turn(role, text)
                else:
                    now.letters.extend(mark)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*done, strict=True)], names=["grp", "repaired_sha256"])
                done = []
        if now is not None:
            done.append(now.end())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*done, strict=True)], names=["grp", "repaired_sha256"])

    return rows.mapInArrow(run, "grp string, repaired_sha256 string")


def turns(rows: DataFrame) -> DataFrame:
    """grp, turn, role, text, hash and copy of ``rows`` (conv_id, turn, role, text and optionally copy); nulls of role and text are one space."""
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    copy = (F.col("copy") if "copy" in rows.columns else F.lit(0)).cast("int").alias("copy")
    named = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("grp")
    return rows.select(named, F.col("turn").cast("long").alias("turn"), *filled, copy).withColumn("hash", F.md5(F.col("text").cast("binary")))


def repair(rows: DataFrame) -> DataFrame:
    """What each conversation of ``rows`` (conv_id, turn, role, text, optionally copy) lacks, and its cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns go by ``turn``, nulls first, ties by
    role, the md5 of the text and copy; turns equal in all of them stay as often as they come, all but one being duplicates. Null roles
    and texts are one space. Null conv_ids form one conversation. Conversations without rows aren't known here; an
    empty table gives no rows. Other columns are left aside. Texts are handled whole: they are read for their flags, and once more, in order, for the digest.
    """
    held = turns(rows)
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    kind = F.lit(len(CLASSES))
    for i, c in enumerate(CLASSES):
        kind = F.when(F.substring("role", 1, 1) == c, i).otherwise(kind)
    marks = held.select("grp", "turn", "role", "hash", "copy", kind.alias("kind"), (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_open"))
    order = ["grp", F.col("turn").asc_nulls_first(), "role", "hash", "copy"]
    dealt = settle(marks.withColumn("at", F.monotonically_increasing_id()), "turns")
    placed = sorted_ranges(dealt, [*order, "at"], RANGE, "placed")
    firsts = placed.where("not is_blank").groupBy("grp", "role", "hash").agg(F.min(F.struct("part", "idx")).alias("at")).select("at.part", "at.idx", F.lit(True).alias("is_first"))
    fault = F.when(F.col("is_blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(F.col("is_open"), TRUNCATED).otherwise(NONE)
    rank = F.when(F.col("fault") == NONE, 0).when(F.col("fault") == TRUNCATED, 1).otherwise(2)
    ready = placed.join(firsts, ["part", "idx"], "left").withColumn("fault", fault).withColumn("symbol", F.col("kind") * 3 + rank)
    ready = settle(ready.select("grp", "part", "idx", "turn", "role", "hash", "copy", "kind", "fault", "symbol"), "ready")

    cut = settle(ready.groupBy("part").applyInArrow(pieces, PIECE), "pieces")
    whole = cut.where("not edge").unionByName(cut.where("edge").groupBy("grp").applyInArrow(chain, PIECE))
    whole = settle(whole, "chained")
    ways = settle(ready.select("grp", "part", "idx", "symbol").groupBy("part").cogroup(whole.groupBy("part")).applyInArrow(traces, TRACE), "traces")
    audits = settle(ways.where("not edge").unionByName(ways.where("edge").groupBy("grp").applyInArrow(follow, TRACE)).select("grp", "part", "audit"), "audits")

    keys = ["grp", "turn", "role", "hash", "copy", "part"]
    letters = audits.join(whole.select(*keys), ["grp", "part"]).select(*keys, F.col("audit").alias("mark"), F.lit(None).cast("string").alias("text"))
    read = held.select("grp", "turn", "role", "hash", "copy", F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("mark"), "text")
    told = read.unionByName(letters).repartition("grp").sortWithinPartitions(*order, F.col("part").asc_nulls_last())
    hashed = digests(told.select("grp", "mark", "role", "text"))

    counts = whole.groupBy("grp").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.sum("cost").cast("long").alias("cost")
    )
    joined = audits.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    conv = F.expr("if(grp = '', null, cast(substring(grp, 2) as bigint))").alias("conv_id")
    return counts.join(joined, "grp").join(hashed, "grp").select(conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows broken by the crc32 of ``conv_id:turn`` modulo 20, a null being one space there too.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20

    def given(name: str, cases: dict[int, Column]) -> Column:
        out = F.coalesce(F.col(name), F.lit(" "))
        for k, value in cases.items():
            out = F.when(F.col("what") == k, value).otherwise(out)
        return out.alias(name)

    text = F.coalesce(F.col("text"), F.lit(" "))
    copies = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    broken = rows.select("conv_id", "turn", "role", "text", what.alias("what")).where("what <> 0")
    return broken.select("conv_id", "turn", given("role", {4: F.lit("user")}), given("text", {1: F.lit(""), 2: F.translate(text, ".!?", "")}), F.explode(copies).alias("copy"))
