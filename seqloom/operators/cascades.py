"""Deleting over a graph of tables: what goes, what is unset, what forbids it, each by the links that are declared."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


class Refused(RuntimeError):
    """Rows that stay refer to rows that would go."""


@dataclass(frozen=True)
class Link:
    """``table.column`` names ``of.key``. When the named row goes, the naming one goes too ("delete"), loses the name ("unset"), or, if it would stay, forbids the change ("refuse").

    With ``via`` = (link table, its column for ``of.key``, its column for ``table.column``) the two meet in a link table instead: a row
    of ``table`` goes when any row that it is linked to goes.
    """

    table: str
    column: str
    of: str
    key: str
    action: str = "delete"
    via: tuple[str, str, str] | None = None


def order(links: Sequence[Link]) -> list[str]:
    """The tables, each after those whose rows it names; a circle is refused."""
    if bad := sorted({link.action for link in links} - {"delete", "unset", "refuse"}):
        raise ValueError(f"no such action: {', '.join(bad)}")
    above: dict[str, set[str]] = {}
    for link in links:
        above.setdefault(link.table, set())
        if link.action == "delete":
            above[link.table].add(link.of)
        else:
            above.setdefault(link.of, set())
    try:
        return list(TopologicalSorter(above).static_order())
    except CycleError as e:
        raise ValueError("links run in a circle: " + " -> ".join(reversed(e.args[1]))) from e


class Cascade:
    """What goes with the rows of ``root`` that ``rows`` are.

    Tables are judged in the order of their links, each in one pass: a left join for each link with the
    distinct keys that go. Those keys are written to the shared folder, so that a table is read once
    however many name it and a lost executor costs one step. Nulls name nothing. Rows that are
    equal are treated alike; tables that no link reaches stay. Nothing is changed here: ``left``, ``gone`` and ``counts`` say what a change would leave.
    """

    def __init__(self, tables: dict[str, DataFrame], links: Sequence[Link], root: str, rows: DataFrame):
        self.tables, self.links, self.root = tables, list(links), root
        if missing := sorted({t for x in links for t in (x.table, x.of, *(x.via or ())[:1])} - set(tables)):
            raise ValueError(f"no table {', '.join(missing)}")
        self._keys: dict[tuple[str, str], DataFrame] = {}
        self.counts: dict[str, int] = {}
        self._own = self._written(root, rows)
        for name in order(links):
            if name != root and any(x.table == name and x.action == "delete" and (x.of, x.key) in self._keys for x in self.links):
                self._written(name, self.gone(name))
        for link in self.links:
            if link.action == "refuse" and (link.of, link.key) in self._keys and not self._staying(link).isEmpty():
                raise Refused(f"{link.table}.{link.column} refers to rows of {link.of} that would go")

    def _written(self, name: str, gone: DataFrame) -> DataFrame:
        named = sorted({x.key for x in self.links if x.of == name})
        kept = written(gone.select(*named) if named else gone.select(F.lit(1).alias("one")), "cascade")
        self.counts[name] = kept.count()
        for key in named:
            self._keys[name, key] = kept.select(F.col(key).alias("__key")).where("__key is not null").distinct()
        return kept

    def _named(self, link: Link) -> DataFrame:
        keys = self._keys[link.of, link.key]
        if link.via is None:
            return keys
        table, there, here = link.via
        pairs = self.tables[table].select(F.col(there).alias("__key"), F.col(here).alias("__here")).where("__here is not null")
        return pairs.join(keys, "__key", "left_semi").select(F.col("__here").alias("__key")).distinct()

    def _marked(self, name: str, rows: DataFrame) -> DataFrame:
        hits = []
        for link in [x for x in self.links if x.table == name and x.action == "delete" and (x.of, x.key) in self._keys]:
            mark = f"__gone{len(hits)}"
            keys = self._named(link).select(F.col("__key").alias(f"__key{len(hits)}"), F.lit(True).alias(mark))
            rows = rows.join(keys, F.col(link.column) == F.col(f"__key{len(hits)}"), "left").drop(f"__key{len(hits)}")
            hits.append(mark)
        gone = reduce(lambda a, b: a | b, [F.coalesce(F.col(h), F.lit(False)) for h in hits], F.lit(False))
        return rows.withColumn("__gone", gone).drop(*hits)

    def gone(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """The rows of a table that go with those of the root, with all their columns. Not for the root itself, whose rows the caller named."""
        if name == self.root:
            raise ValueError("the root's rows are the caller's")
        return self._marked(name, self.tables[name] if rows is None else rows).where("__gone").drop("__gone")

    def _staying(self, link: Link) -> DataFrame:
        stay = self._marked(link.table, self.tables[link.table]).where("not __gone") if link.table != self.root else self.tables[link.table]
        return stay.join(self._named(link), F.col(link.column) == F.col("__key"), "left_semi")

    def left(self, name: str) -> DataFrame:
        """What stays of a table that isn't the root, with names unset where that is declared."""
        if name == self.root:
            raise ValueError("the root's rows are the caller's")
        out = self._marked(name, self.tables[name]).where("not __gone").drop("__gone")
        for link in [x for x in self.links if x.table == name and x.action == "unset" and (x.of, x.key) in self._keys]:
            out = out.join(self._named(link).withColumn("__hit", F.lit(True)), F.col(link.column) == F.col("__key"), "left")
            out = out.withColumn(link.column, F.when(F.col("__hit").isNull(), F.col(link.column))).drop("__key", "__hit")
        return out
