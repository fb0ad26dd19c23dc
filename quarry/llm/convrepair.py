"""Structure repair of conversations by generalised LR parsing with edits.

The role initials of a conversation must be a sentence of the role grammar
``D → ε | B, B → s P | P | B P, P → u a``.  ``Repair`` builds its LR(0)
states and parses with weighted edits: a row is kept (0), given another role
(2) or deleted (3, required for blank and repeated rows), and an empty turn
can be inserted anywhere (2); a cut-off row that stays costs 1 more.  The
stacks of all parses form one graph: a node is an LR state with the node
beneath it, shared by all parses that have it.  The grammar is left
recursive, so that the graph has few nodes; it is built once, with the nodes
that each role initial leads to after all reductions.  Parses that meet in a
node are merged by the least (cost, audit).  No audit of equal cost and rows
is the start of another, so what is merged away can't win later.

The way from node to node through some rows is a table of least (cost,
audit), and tables of adjoining rows join to one.  So a conversation can be cut
anywhere: rows are range-partitioned by (conversation, turn, ...) and read in
order; a task finishes the conversations that it holds whole, up to ``HELD``
rows.  The first and last of a partition and longer ones are left open: their
parts give tables, which are joined part by part (a step over parts, not
rows), and the edits go back to the rows of each part.  No task holds a long
conversation's rows.  Only its audit, a single value of the result, and the
digest that the query takes, whose bytes run in order, are made by one task.

Rows stand by turn (nulls first), then role and text by their first 64
characters, then by digest.  Null roles and texts are one space.  A row's
first fault counts: blank, duplicate (role and text seen earlier), truncated.
A role without an initial fits nowhere.  A conversation without rows costs
nothing.  An empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import exact, stored

#: fixed values: the role grammar, the costs of the edits, the roles that edits can give
GRAMMAR = {"D": ["", "B"], "B": ["sP", "P", "BP"], "P": ["ua"]}
START = "D"
RETAG, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: no rest of a parse costs more than this over the same rest from another node: at most two inserts reach a whole pair,
#: from which a system's turn that the other keeps is deleted, or one insert opens the pair that the other has open
APART = 2 * INSERT + DELETE
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
FINE, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3

HELD = 2048             # rows of a conversation that a task finishes by itself
PIECE = 256             # rows of one piece of a long conversation
SETTLE = 64             # rows between two removals of the audits' common start


class Repair:
    """The graph of stacks of a grammar, and the least edits through it."""

    def __init__(self, grammar: dict[str, list[str]] = GRAMMAR, start: str = START):
        self.grammar, self.start = grammar, start
        self.signs = sorted({c for rules in grammar.values() for r in rules for c in r if c not in grammar})
        first = self._closure({(start, r, 0) for r in grammar[start]})
        self.root = (first, None)
        self.nodes = [self.root]
        self.to: list[dict[str, list[int]]] = []
        number = {self.root: 0}
        for node in self.nodes:                       # grows while it is read
            row = {}
            for sign in self.signs:
                out = []
                for n in self._pushed(node, sign):
                    if n not in number:
                        if len(number) > 4096:
                            raise ValueError("the grammar's stacks are not bounded")
                        number[n] = len(self.nodes)
                        self.nodes.append(n)
                    out.append(number[n])
                if out:
                    row[sign] = out
            self.to.append(row)
        self.accepts = {k for k, n in enumerate(self.nodes) if self._complete(n)}
        self.inserts = [[t for sign in ROLES for t in row.get(sign, ())] for row in self.to]

    def _closure(self, items: set) -> frozenset:
        items, new = set(items), list(items)
        while new:
            _, rule, dot = new.pop()
            for r in self.grammar.get(rule[dot:dot + 1], ()):
                item = (rule[dot], r, 0)
                if item not in items:
                    items.add(item)
                    new.append(item)
        return frozenset(items)

    def _goto(self, state: frozenset, sign: str) -> frozenset:
        return self._closure({(left, r, d + 1) for left, r, d in state if r[d:d + 1] == sign})

    def _reduced(self, node: tuple) -> Iterator[tuple]:
        """(left side, node beneath the rule) of every reduction."""
        for left, rule, dot in node[0]:
            if dot == len(rule):
                base = node
                for _ in rule:
                    base = base[1]
                yield left, base

    def _pushed(self, node: tuple, sign: str) -> list[tuple]:
        """Nodes that can still shift or be accepted, after ``sign`` and all reductions."""
        state = self._goto(node[0], sign)
        if not state:
            return []
        out, new = [], [(state, node)]
        while new:
            top = new.pop()
            if any(self._goto(top[0], s) for s in self.signs) or self._complete(top):
                out.append(top)
            for left, base in self._reduced(top):
                if left != self.start:
                    new.append((self._goto(base[0], left), base))
        return out

    def _complete(self, node: tuple) -> bool:
        return any(left == self.start and base == self.root for left, base in self._reduced(node))

    # -- parsing: a front is {node: (cost, audit)}

    def _with_inserts(self, front: dict) -> dict:
        new = list(front)
        while new:
            at = new.pop()
            cost, audit = front[at]
            way = (cost + INSERT, audit + "I")
            for t in self.inserts[at]:
                if t not in front or way < front[t]:
                    front[t] = way
                    new.append(t)
        return front

    def begin(self, node: int = 0) -> dict:
        return self._with_inserts({node: (0, "")})

    def step(self, front: dict, sign: str, fault: int) -> dict:
        """The front behind one more row."""
        out: dict = {}
        stays = fault < DUPLICATE
        more = CUT_OFF if fault == TRUNCATED else 0

        def add(t: int, way: tuple) -> None:
            if t not in out or way < out[t]:
                out[t] = way

        for at, (cost, audit) in front.items():
            add(at, (cost + DELETE, audit + "D"))
            if stays:
                for t in self.to[at].get(sign, ()):
                    add(t, (cost + more, audit + "K"))
                way = (cost + RETAG + more, audit + "R")
                for t in self.inserts[at]:
                    add(t, way)
        out = self._with_inserts(out)
        most = min(out.values())[0] + APART            # beyond it a parse can't win, nor tie
        return {t: way for t, way in out.items() if way[0] <= most}

    def through(self, rows: list[tuple[str, int]], node: int = 0) -> tuple[str, dict]:
        """(start common to all audits, front) behind (initial, fault) rows from ``node``."""
        front, done = self.begin(node), []
        for k, (sign, fault) in enumerate(rows, 1):
            front = self.step(front, sign, fault)
            if k % SETTLE == 0:
                done.append(_settle(front))
        return "".join(done), front

    def best(self, front: dict) -> tuple[int, str]:
        return min(front[t] for t in front if t in self.accepts)

    def joined(self, front: dict, table: dict) -> dict:
        """The front behind a part whose table is {node: {node: (cost, audit)}}."""
        out: dict = {}
        for at, (cost, audit) in front.items():
            for t, (c, a) in table[at].items():
                way = (cost + c, audit + a)
                if t not in out or way < out[t]:
                    out[t] = way
        return out


def _settle(front: dict) -> str:
    """Takes the audits' common start off; orders among them stay."""
    start = os.path.commonprefix([a for _, a in front.values()])
    if start:
        for t, (c, a) in front.items():
            front[t] = (c, a[len(start):])
    return start


def fault_of(text: str, seen: bool) -> int:
    end = text.rstrip(SPACE)
    return BLANK if not end else DUPLICATE if seen else FINE if end[-1] in ENDS else TRUNCATED


def gap_count(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def illegal_count(signs: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(signs, signs[1:]))


def edited(audit: str, rows: list[tuple[str, str]], before: int = 0, system: bool | None = None) -> list[tuple[str, str, str]]:
    """Repaired (role, text, edit) turns; ``before`` turns stand before them, ``system`` tells whether the first of all is a system's."""
    out, k = [], 0
    for e in audit:
        role, text = rows[k] if e != "I" else ("", "")
        k += e != "I"
        if e == "D":
            continue
        if system is None:
            system = e == "K" and role[:1] == "s"
        if e != "K":
            role = ROLES["ua"[(before + len(out) - system) % 2]]
        out.append((role, text, e))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows harmed by ``crc32(conv_id:turn) % 20``: 0 drops, 1 empties, 2 cuts sentence ends, 3 repeats, 4 makes a user's."""
    rows = exact(conversations, "conv_id", "turn", "role", "text")
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in rows.columns}
    rows = rows.select("conv_id", "turn", blank["role"].alias("role"), blank["text"].alias("text"),
                       (F.crc32(F.concat(blank["conv_id"], F.lit(":"), blank["turn"])) % 20).alias("_harm"))
    harm = F.col("_harm")
    text = F.when(harm == 1, F.lit("")).when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter(harm != 0).select("conv_id", "turn", F.when(harm == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                                         F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_COUNTS = ", ".join(f"{c} long" for c in _STATS)
_TURNS = "array<struct<role string, text string, edit string>>"
_TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def _turn_dicts(turns: list[tuple[str, str, str]]) -> list[dict]:
    return [{"role": r, "text": t, "edit": e} for r, t, e in turns]


def _first_pass(rows: DataFrame) -> DataFrame:
    """Finished conversations, and the rows of open ones (``pos`` not null), written once."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    turn_type = rows.schema["turn"].dataType.simpleString()
    names = ["conv_id", "part", "pos", "turn", "role", "text", "digest", "fault", *_STATS, "audit", "turns"]
    schema = f"conv_id {id_type}, part int, pos long, turn {turn_type}, role string, text string, digest binary, fault int, {_COUNTS}, audit string, turns {_TURNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, part = Repair(), TaskContext.get().partitionId()
        types: list = []
        out: list[tuple] = []
        held: list[tuple] = []           # rows of the conversation at hand: turn, role, text, digest, fault
        seen: set = set()
        state = {"id": None, "pos": None, "first": True}

        def open_rows() -> None:
            for turn, role, text, digest, fault in held:
                out.append((state["id"], part, state["pos"], turn, role, text, digest, fault, *[None] * 6, None, None))
                state["pos"] += 1
            held.clear()

        def finish() -> None:
            if state["pos"] is not None:
                return open_rows()
            signs = [r[1][:1] for r in held]
            faults = [r[4] for r in held]
            start, front = repair.through(list(zip(signs, faults)))
            cost, audit = repair.best(front)
            out.append((state["id"], part, None, None, None, None, None, None, gap_count([r[0] for r in held]),
                        faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_count(signs), cost, start + audit,
                        _turn_dicts(edited(start + audit, [(r[1], r[2]) for r in held]))))
            held.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            if not types:
                types = [b.schema.field("conv_id").type, pa.int32(), pa.int64(), b.schema.field("turn").type, pa.string(), pa.string(), pa.binary(),
                         pa.int32(), *[pa.int64()] * 6, pa.string(), _TURN_TYPE]
            ids, turns, roles, texts, digests = (b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest"))
            for row in zip(ids, turns, roles, texts, digests):
                if state["first"] or row[0] != state["id"]:
                    if not state["first"]:
                        finish()
                    # a partition's first conversation may have begun before it
                    state["pos"], state["id"], state["first"] = (0 if state["first"] else None), row[0], False
                    seen = set()
                fault = fault_of(row[3], row[4] in seen)
                seen.add(row[4])
                held.append((*row[1:], fault))
                if state["pos"] is not None or len(held) > HELD:
                    state["pos"] = state["pos"] or 0
                    open_rows()
            if out:
                yield flush()
        if held:                                         # the last may go on in the next partition
            state["pos"] = state["pos"] or 0
            open_rows()
        if out:
            yield flush()

    spark = rows.sparkSession
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("digest"), F.col("_row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.withColumn("_role", F.substring("role", 1, 64)).withColumn("_text", F.substring("text", 1, 64))
             .withColumn("digest", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text")))).withColumn("_row", F.monotonically_increasing_id())
             .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_role", "_text", "_row"))
    return stored(dealt.mapInArrow(run, schema), "conversations")


def _tables(open_rows: DataFrame) -> DataFrame:
    """One row for each conversation and part: its counts and its table of ways."""
    slim = open_rows.select("conv_id", "part", "pos", "turn", F.substring("role", 1, 1).alias("sign"), "digest", "fault")
    # seen earlier in another part: at most one row for a part and digest
    early = Window.partitionBy("conv_id", "digest").orderBy("part")
    news = slim.filter(F.col("fault") < DUPLICATE).withColumn("_n", F.row_number().over(early)) \
        .withColumn("fault", F.when(F.col("_n") > 1, F.lit(DUPLICATE)).otherwise(F.col("fault"))).drop("_n")
    rows = slim.filter(F.col("fault") >= DUPLICATE).unionByName(news).drop("digest")
    turn = open_rows.schema["turn"].dataType.simpleString()
    id_type = open_rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "n", "blank", "duplicate", "truncated", "illegal", "head", "tail", "least", "most", "turns", "begins", "ends",
             "from_node", "to_node", "cost", "audit"]
    schema = (f"conv_id {id_type}, part int, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, least {turn}, "
              f"most {turn}, turns long, begins {turn}, ends {turn}, from_node array<int>, to_node array<int>, cost array<long>, audit array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair()
        types: list = []

        def finish(key: tuple, rows: list) -> pa.RecordBatch:
            ways = []
            for node in range(len(repair.nodes)):
                start, front = repair.through([r[1:] for r in rows], node)
                ways += [(node, t, c, start + a) for t, (c, a) in front.items()]
            turns = {r[0] for r in rows if r[0] is not None}
            faults, signs = [r[2] for r in rows], [r[1] for r in rows]
            row = (*key, len(rows), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_count(signs), signs[0], signs[-1],
                   min(turns, default=None), max(turns, default=None), len(turns), rows[0][0], rows[-1][0], *map(list, zip(*ways)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        key, rows = None, []
        for b in batches:
            if not types:
                i, t = b.schema.field("conv_id").type, b.schema.field("turn").type
                types = [i, pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), t, t, pa.int64(), t, t,
                         pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
            for c, p, *row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "part", "turn", "sign", "fault"))):
                if rows and (c, p) != key:
                    yield finish(key, rows)
                    rows = []
                key = (c, p)
                rows.append(tuple(row))
        if rows:
            yield finish(key, rows)

    parts = int(open_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "conv_id", "pos").mapInArrow(run, schema)


def _joined(tables: DataFrame) -> DataFrame:
    """Each open conversation's verdict (``part`` null) and its edits cut by part."""
    id_type = tables.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", *_STATS, "audit", "before", "system"]
    schema = f"conv_id {id_type}, part int, {_COUNTS}, audit string, before long, system boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair()
        types: list = []

        def finish(conv, done: list[str], front: dict, parts: list[tuple], s: dict) -> pa.RecordBatch:
            cost, audit = repair.best(front)
            audit = "".join([*done, audit])
            gaps = s["most"] - s["least"] + 1 - s["turns"] if s["least"] is not None else 0
            out = [(conv, None, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit, None, None)]
            at = before = 0
            # a sentence of odd length begins with a system's turn, and only a kept row can be one
            system = (len(audit) - audit.count("D")) % 2 == 1
            for k, (part, n) in enumerate(parts):
                end, left = at, n
                while left or (k == len(parts) - 1 and end < len(audit)):
                    left -= audit[end] != "I"
                    end += 1
                piece = audit[at:end]
                out.append((conv, part, *[None] * 6, piece, before, system))
                before += len(piece) - piece.count("D")
                at = end
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        conv, parts, front, done, s = None, [], {}, [], {}
        for b in batches:
            if not types:
                types = [b.schema.field("conv_id").type, pa.int32(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.bool_()]
            for row in b.to_pylist():
                if parts and row["conv_id"] != conv:
                    yield finish(conv, done, front, parts, s)
                    parts = []
                if not parts:
                    conv, front, done = row["conv_id"], {0: (0, "")}, []
                    s = dict(blank=0, duplicate=0, truncated=0, illegal=0, turns=0, least=None, most=None, tail=None, ends=None)
                table: dict = {}
                for f, t, c, a in zip(row["from_node"], row["to_node"], row["cost"], row["audit"]):
                    table.setdefault(f, {})[t] = (c, a)
                front = repair.joined(front, table)
                done.append(_settle(front))
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    s[c] += row[c]
                if parts:
                    s["illegal"] += s["tail"] + row["head"] not in LEGAL
                    s["turns"] -= s["ends"] is not None and s["ends"] == row["begins"]
                for c, pick in (("least", min), ("most", max)):
                    s[c] = pick(v for v in (s[c], row[c]) if v is not None) if (s[c], row[c]) != (None, None) else None
                s["tail"], s["ends"] = row["tail"], row["ends"]
                parts.append((row["part"], row["n"]))
        if parts:
            yield finish(conv, done, front, parts, s)

    parts = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def _row_edits(slices: DataFrame) -> DataFrame:
    """One row for each row of an open conversation: its edits (inserts before it, its own, at the end those behind it)."""
    id_type = slices.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                edits, before, start = [], [], 0
                done, audit = row["before"], row["audit"]
                for k, e in enumerate(audit):
                    if e != "I":
                        edits.append(audit[start:k + 1])
                        start = k + 1
                edits[-1] += audit[start:]
                for e in edits:
                    before.append(done)
                    done += len(e) - e.count("D")
                n = len(edits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["conv_id"]] * n, b.schema.field("conv_id").type), pa.array([row["part"]] * n, pa.int32()), pa.array(range(n), pa.int64()),
                     pa.array(edits, pa.string()), pa.array(before, pa.int64()), pa.array([row["system"]] * n, pa.bool_())],
                    ["e_id", "e_part", "e_pos", "edits", "before", "system"])

    return slices.mapInArrow(run, f"e_id {id_type}, e_part int, e_pos long, edits string, before long, system boolean")


def _open_pieces(open_rows: DataFrame, slices: DataFrame) -> DataFrame:
    """Repaired turns of open conversations, ``PIECE`` rows to a piece."""
    edits = _row_edits(slices)
    rows = open_rows.select("conv_id", "part", "pos", "role", "text").join(
        edits, F.col("conv_id").eqNullSafe(F.col("e_id")) & (F.col("part") == F.col("e_part")) & (F.col("pos") == F.col("e_pos")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_turn_dicts(edited(e, [(r, t)], n, s)) for e, r, t, n, s in
                   zip(*(b.column(c).to_pylist() for c in ("edits", "role", "text", "before", "system")))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), b.column("pos"), pa.array(got, _TURN_TYPE)],
                                             ["conv_id", "part", "pos", "turns"])

    id_type = open_rows.schema["conv_id"].dataType.simpleString()
    turns = rows.select("conv_id", "part", "pos", "edits", "role", "text", "before", "system") \
        .mapInArrow(run, f"conv_id {id_type}, part int, pos long, turns {_TURNS}")
    block = (F.col("pos") / PIECE).cast("long")
    pieces = turns.groupBy("conv_id", "part", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "turns"))).alias("r"))
    return pieces.select("conv_id", "part", "block", F.flatten(F.transform("r", lambda x: x["turns"])).alias("turns"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, pieces) of the conversations that have rows.

    verdicts: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    pieces: conv_id, part, block, turns (role, text, edit), single; a
    conversation's pieces stand in order of (part, block).  ``single`` ones
    are a whole conversation; only long conversations and those at the edge of
    a partition have others.
    """
    first = _first_pass(exact(conversations, "conv_id", "turn", "role", "text"))
    whole, open_rows = first.filter("pos IS NULL"), first.filter("pos IS NOT NULL")
    joined = stored(_joined(_tables(open_rows)), "conversation-edits")
    verdicts = whole.select("conv_id", *_STATS, "audit").unionByName(joined.filter("part IS NULL").select("conv_id", *_STATS, "audit"))
    slices = joined.filter("part IS NOT NULL").select("conv_id", "part", "audit", "before", "system")
    pieces = whole.select("conv_id", "part", F.lit(0).cast("long").alias("block"), "turns", F.lit(True).alias("single")) \
        .unionByName(_open_pieces(open_rows, slices).withColumn("single", F.lit(False)))
    return verdicts, pieces


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, sha256 of the repaired ``role:text`` lines; none for conversations in pieces of no turns.

    A digest takes its bytes in order: the pieces of one conversation stream
    through one task, batch by batch.
    """
    lines = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    id_type = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, at, kind = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([sha.hexdigest()])], ["conv_id", "sha256"])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, text in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
                if sha is None or conv != at:
                    if sha is not None:
                        yield done()
                    sha, at = hashlib.sha256(), conv
                else:
                    sha.update(b"\n")
                sha.update(text.encode())
        if sha is not None:
            yield done()

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = pieces.filter("NOT single AND size(turns) > 0").select("conv_id", "part", "block", lines.alias("lines")) \
        .repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, f"conv_id {id_type}, sha256 string")
    return pieces.filter("single").select("conv_id", F.sha2(lines, 256).alias("sha256")).unionByName(rest)


def repair_report(original: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conversation of ``original``, with the verdict and digest of its repaired rows in ``conversations``."""
    verdicts, pieces = repair(conversations)
    ids = exact(original, "conv_id").distinct()
    both = verdicts.join(digests(pieces).select(F.col("conv_id").alias("_id"), "sha256"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    found = ids.select(F.col("conv_id").alias("_id")).join(both, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return found.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _STATS],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
