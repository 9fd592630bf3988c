"""A Newick tree read in byte ranges, so that one of any size is many tasks and no task holds it.

Records end at commas, where Spark's text source can cut a file. Nodes are numbered as they are met: each
``(`` and each ``,`` makes the next one. A node after ``(`` is a child of the node before it; one after ``,``
belongs to the last ``(`` that reached its depth, and so does what follows a ``)``. A first pass sums each
block up (nodes made, change of depth, whether it ends inside quotes or a comment) for each of the
three ways it may begin; the sums chain along the file. The second pass numbers nodes and finds
parents within the block; what an earlier block opened is asked for by depth, and a window over the open
places of each depth, one a block at most, answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import blocks, ship, written

NEWICK = "node_index long, name string, branch_length double, edge_id long, parent_index long, is_tip boolean"
#: Records that are scanned together; characters within one pair of quotes or brackets that a border may cut.
CHUNK, MOST_QUOTED = 20_000, 1 << 20
#: Blocks whose sums are broadcast.
MAX_BROADCAST_BLOCKS = 100_000

_TOKEN = re.compile(r"(?P<quoted>'(?:[^']|'')*+')|(?P<comment>\[[^\]]*\])|(?P<edge>\{[^}]*\})|(?P<length>:[^(),;{\[]*)|(?P<mark>[(),;])|(?P<open>['\[].*)|(?P<bare>[^\s(),:;{\['][^(),:;{\[]*)", re.S)
_SUMS = "file string, block long, nodes array<long>, depth array<long>, mode array<int>, done array<boolean>, head array<string>"
_STARTS = "file string, block long, node long, depth long, mode int, suffix string, over boolean"
_ROWS = "file string, block long, kind int, node long, parent long, ask long, closed boolean, is_tip boolean, name string, branch_length double, edge_id long"


def _texts(batches) -> Iterator[tuple]:
    """(file, block, first row of the batch's stretch, text) of CHUNK records of a block at most; all records but a file's first begin with their comma."""
    now, held, first = None, [], None

    def out():
        return (*now, first, "".join(held))

    for batch in batches:
        rows = batch.to_pydict()
        for k, (file, block, value) in enumerate(zip(rows["file"], rows["block"], rows["value"], strict=True)):
            if (file, block) != now:
                if held:
                    yield out()
                now, held, first = (file, block), [], {c: rows[c][k] for c in rows if c not in ("file", "block", "value")}
                held.append(value if block == 0 else "," + value)
            else:
                if len(held) >= CHUNK:
                    yield out()
                    held = []
                held.append("," + value)
    if held:
        yield out()


class _Sum:
    """A block as seen from one way to begin: plain, inside quotes, inside a comment."""

    def __init__(self, mode: int):
        self.carry = ("", "'", "[")[mode]  # text that isn't closed yet
        self.nodes = self.depth = 0
        self.done = False  # the tree has ended
        self.head: list[str] = []  # what still belongs to the last node of the block before
        self.heading = bool(mode)  # no mark has come yet
        self.lost = False  # it would be inside quotes for too long

    def add(self, text: str) -> None:
        if self.done or self.lost:
            return
        if len(self.carry) > MOST_QUOTED:
            self.lost = True
            return
        begun, text, self.carry = len(self.carry), self.carry + text, ""
        heading, end = self.heading, len(text)
        for m in _TOKEN.finditer(text):
            if m.lastgroup == "open":
                self.carry = m.group()
                break
            if m.lastgroup == "mark":
                if self.heading:
                    self.heading, end = False, m.start()
                c = m.group()
                if c == ";":
                    self.done = True
                    break
                self.nodes += c != ")"
                self.depth += {"(": 1, ")": -1, ",": 0}[c]
        if heading:
            self.head.append(text[begun:end])

    def mode(self) -> int:
        return {"": 0, "'": 1, "[": 2}[self.carry[:1]]


def _sums(lines: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        now, ways = None, []

        def told():
            cols = [[now[0]], [now[1]], [[w.nodes for w in ways]], [[w.depth for w in ways]], [[-1 if w.lost or len(w.carry) > MOST_QUOTED else w.mode() for w in ways]], [[w.done for w in ways]], [["" if w.lost else "".join(w.head) for w in ways]]]
            types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["file", "block", "nodes", "depth", "mode", "done", "head"])

        for file, block, _, text in _texts(batches):
            if (file, block) != now:
                if now:
                    yield told()
                now, ways = (file, block), [_Sum(m) for m in range(3)]
            for w in ways:
                w.add(text)
        if now:
            yield told()

    return lines.mapInArrow(run, _SUMS)


def _starts(sums: DataFrame) -> DataFrame:
    """Of each block the nodes made before it, its depth, how it begins, and text of later blocks that ends its last node's; a file's blocks meet in one task, not its nodes."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        out, node, depth, mode, over = [], 0, 0, 0, False
        for r in rows:
            if mode and not over:
                k = len(out) - 1
                while k >= 0 and out[k][6]:
                    k -= 1
                out[k][5] += r["head"][mode]
            out.append([r["file"], r["block"], node, depth, mode, "", over])
            if over:
                continue
            node, depth, over = node + r["nodes"][mode], depth + r["depth"][mode], r["done"][mode]
            whole = mode and r["nodes"][mode] == 0 and r["depth"][mode] == 0 and not over and r["mode"][mode] == mode
            if whole:  # nothing of its own: all of it goes on with the node of before
                out[-1][6] = True
            mode = r["mode"][mode]
            if mode < 0:
                raise ValueError(f"{r['file']}: quotes or brackets around more than {MOST_QUOTED} characters")
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["file", "block", "node", "depth", "mode", "suffix", "over"])

    return sums.groupBy("file").applyInArrow(run, _STARTS)


class _Block:
    """Numbers the nodes of one block and finds the parents that it can."""

    def __init__(self, node: int, depth: int, mode: int, first: bool):
        self.next, self.depth, self.carry = node + 1, depth, ("", "'", "[")[mode]
        self.skip = bool(mode)  # text up to the first mark belongs to an earlier block
        self.open: list[int] = []  # first children of the places opened here
        self.rows: list[list] = []  # [kind, node, parent, ask, closed, is_tip, name, length, edge]
        self.at: dict[int, list] = {}  # nodes of this block that are open or last
        self.last: list | None = None  # the row that text belongs to
        self.done = False
        if first:
            self.last = self._node(0, None, None)

    def _node(self, node: int, parent: int | None, ask: int | None) -> list:
        row = [0, node, parent, ask, True, True, None, None, None]
        self.rows.append(row)
        return row

    def add(self, text: str) -> None:
        if self.done:
            return
        text, self.carry = self.carry + text, ""
        for m in _TOKEN.finditer(text):
            kind, said = m.lastgroup, m.group()
            if kind == "open":
                self.carry = said
                return
            if kind == "mark":
                self.skip = False
                if said == "(":
                    if self.last is not None:
                        self.last[4] = self.last[5] = False
                        self.at[self.last[1]] = self.last
                    self.open.append(self.next)
                    self.depth += 1
                    self.last = self._node(self.next, self.next - 1, None)
                    self.next += 1
                elif said == ",":
                    self.last = self._node(self.next, self.open[-1] - 1 if self.open else None, None if self.open else self.depth)
                    self.next += 1
                elif said == ")":
                    if self.open:
                        self.last = self.at.pop(self.open.pop() - 1)
                        self.last[4] = True
                    else:
                        self.last = [1, None, None, self.depth, True, False, None, None, None]
                        self.rows.append(self.last)
                    self.depth -= 1
                else:
                    self.done = True
                    return
            elif self.skip or self.last is None:
                continue
            elif kind == "bare":
                self.last[6] = said.strip()
            elif kind == "quoted":
                self.last[6] = said[1:-1].replace("''", "'")
            elif kind == "length":
                self.last[7] = float(said[1:].strip())
            elif kind == "edge":
                self.last[8] = int(said[1:-1].strip())

    def take(self) -> list[list]:
        """The rows that nothing will change any more."""
        out = [r for r in self.rows if r[4] and r is not self.last]
        self.rows = [r for r in self.rows if not (r[4] and r is not self.last)]
        return out

    def end(self) -> list[list]:
        low = self.depth - len(self.open)
        return self.rows + [[2, first, None, low + k + 1, True, False, None, None, None] for k, first in enumerate(self.open)]


def _parsed(lines: DataFrame, starts: DataFrame) -> DataFrame:
    import pyarrow as pa

    few = starts.count() <= MAX_BROADCAST_BLOCKS
    given = lines.join(F.broadcast(starts), ["file", "block"]) if few else lines.withColumn("row", F.monotonically_increasing_id()).join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "row").drop("row")
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.float64(), pa.int64()]
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches):
        now, block, start = None, None, None

        def told(rows):
            for k in range(0, len(rows), 20_000):
                cols = list(zip(*((*now, *r) for r in rows[k : k + 20_000]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def ended():
            block.add(start["suffix"])
            return told(block.end())

        for file, at, first, text in _texts(batches):
            if (file, at) != now:
                if block is not None:
                    yield from ended()
                now, start = (file, at), first
                block = _Block(start["node"], start["depth"], start["mode"], at == 0)
                block.done = start["over"]
            block.add(text)
            yield from told(block.take())
        if block is not None:
            yield from ended()

    return given.select("file", "block", "value", "node", "depth", "mode", "suffix", "over").mapInArrow(run, _ROWS)


def newick(spark: SparkSession, *paths: str, chained: bool = False) -> DataFrame:
    """NEWICK columns; in each file nodes are numbered from 0, the root, whose parent is null. ``{n}`` after a branch is its edge.

    ``chained``: all files are the text of one tree in the order of their names; each but the last must end with a comma.
    """
    ship(spark)
    lines, _ = blocks(spark, list(paths), ",", chained)
    starts = written(_starts(_sums(lines)), "starts")
    rows = written(_parsed(lines, starts), "nodes")
    asks = rows.where("ask IS NOT NULL AND kind < 2").select("file", F.col("ask").alias("depth"), "block").distinct().withColumn("node", F.lit(None).cast("long"))
    places = rows.where("kind = 2").select("file", F.col("ask").alias("depth"), "block", "node")
    before = Window.partitionBy("file", "depth").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # what a block leaves open at a depth counts for later blocks alone
    merged = places.union(asks).groupBy("file", "depth", "block").agg(F.max("node").alias("node"), F.count_if(F.col("node").isNull()).alias("asked"))
    found = merged.withColumn("above", F.last("node", ignorenulls=True).over(before) - 1).where("asked > 0").select("file", F.col("depth").alias("ask"), "block", "above")
    columns = ["name", "branch_length", "edge_id"]
    nodes = rows.where("kind = 0 AND ask IS NULL").select("file", "node", "parent", "closed", "is_tip", *columns)
    asking = rows.where("kind = 0 AND ask IS NOT NULL").join(found, ["file", "ask", "block"], "left").select("file", "node", F.col("above").alias("parent"), "closed", "is_tip", *columns)
    every = nodes.union(asking)
    closings = rows.where("kind = 1").join(found, ["file", "ask", "block"]).select("file", F.col("above").alias("node"), *[F.col(c).alias(f"own_{c}") for c in columns])
    late = every.where("NOT closed").join(closings, ["file", "node"], "left").select("file", "node", "parent", "is_tip", *[F.coalesce(f"own_{c}", c).alias(c) for c in columns])
    out = every.where("closed").select("file", "node", "parent", "is_tip", *columns).union(late)
    return out.select(F.col("node").alias("node_index"), *columns[:2], "edge_id", F.col("parent").alias("parent_index"), "is_tip")
