"""Slice queries: an allow-list of surfaces, integer IN filters, block selectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members up to which a block is one predicate; more are joined as a table.
MAX_PREDICATE_MEMBERS = 256


class SliceError(ValueError):
    """The request isn't one that may run."""


@dataclass(frozen=True)
class Surface:
    """What may be asked of a table: its filter columns, the columns returned, whether a filter must be given, which columns take exactly one value."""

    filters: tuple[str, ...]
    columns: tuple[str, ...] | None = None
    needs_filter: bool = False
    single: tuple[str, ...] = field(default=())


def integers(column: str, values: Sequence[int], single: bool = False) -> list[int]:
    if not values:
        raise SliceError(f"{column}: no values")
    if any(isinstance(v, bool) or not isinstance(v, int) for v in values):
        raise SliceError(f"{column}: values must be integers")
    if single and len(values) != 1:
        raise SliceError(f"{column}: exactly one value")
    return list(values)


def build(table: DataFrame, surface: Surface, where: Mapping[str, Sequence[int]]) -> DataFrame:
    """The rows that satisfy every ``column IN values``; predicates reach the scan."""
    if surface.needs_filter and not where:
        raise SliceError("a filter is needed")
    out = table
    for column, values in where.items():
        if column not in surface.filters:
            raise SliceError(f"{column}: not a filter column")
        out = out.where(F.col(column).isin(integers(column, values, column in surface.single)))
    for column in surface.single:
        if column not in where:
            raise SliceError(f"{column}: exactly one value")
    return out.select(*surface.columns) if surface.columns else out


def scoped(table: DataFrame, membership: DataFrame, key: str, scope: str, values: Sequence[int]) -> DataFrame:
    """Rows of ``table`` for each requested scope that lists their key; a key in two scopes comes twice."""
    chosen = membership.where(F.col(scope).isin(integers(scope, values))).select(key)
    return table.join(chosen, key)


def block(table: DataFrame, members: Sequence[tuple[int, int, int]], owner: str, at: str) -> DataFrame:
    """Rows in any member (owner, first, last; both ends inclusive).

    The coarse bounds in front let the scan skip files and row groups; the exact terms decide. With
    many members the exact part is a join on the owner, so the predicate stays small.
    """
    if not members:
        raise SliceError("no members")
    inside = block_condition(members, owner, at)
    if inside is not None:
        return table.where(inside)
    coarse = F.col(at).between(min(m[1] for m in members), max(m[2] for m in members))
    listed = table.sparkSession.createDataFrame(merged_members(members), f"{owner} long, __first long, __last long")
    return block_join(table.where(coarse), listed, owner, at, "__first", "__last").drop("__first", "__last")


def block_condition(members: Sequence[tuple[int, int, int]], owner: str, at: str) -> Column | None:
    """Whether a row lies in a member, coarse bounds first; None if there are too many members for a predicate."""
    if len(members) > MAX_PREDICATE_MEMBERS:
        return None
    owners = sorted({m[0] for m in members})
    coarse = F.col(at).between(min(m[1] for m in members), max(m[2] for m in members))
    exact = reduce(Column.__or__, [(F.col(owner) == o) & F.col(at).between(a, b) for o, a, b in members])
    return F.col(owner).isin(owners) & coarse & exact


def merged_members(members: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The members with those of an owner that overlap or touch as one, so that a join meets each row once."""
    out: list[tuple[int, int, int]] = []
    for owner, first, last in sorted(m for m in members if m[1] <= m[2]):
        if out and out[-1][0] == owner and first <= out[-1][2] + 1:
            out[-1] = (owner, out[-1][1], max(last, out[-1][2]))
        else:
            out.append((owner, first, last))
    return out


def block_join(table: DataFrame, members: DataFrame, owner: str, at: str, first: str, last: str) -> DataFrame:
    """Range join by owner: an equi-join with the bounds as a residual, so no nested loop. Members of one owner may not overlap."""
    return table.join(members, owner).where(F.col(at).between(F.col(first), F.col(last)))


#: Cells that a member covers on average, and cells of an owner at least; owners whose widths are broadcast.
CELLS_PER_MEMBER, LEAST_CELLS, MAX_BROADCAST_OWNERS = 4, 16, 100_000


def interval_cells(table: DataFrame, members: DataFrame, owner: str, at: str, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """``table`` with the cell of each row, and ``members`` with a row for each cell that they reach; see ``interval_join``."""
    names = [c for c in members.columns if c != owner]
    some = members.where(F.col(owner).isNotNull() & (F.col(first) <= F.col(last)))
    length = F.col(last).cast("double") - F.col(first) + 1
    width = some.groupBy(owner).agg(F.greatest(F.lit(1), F.ceil(F.sum(length) / (CELLS_PER_MEMBER * F.greatest(F.count(F.lit(1)), F.lit(LEAST_CELLS))))).cast("long").alias("__width"))
    few = width.limit(MAX_BROADCAST_OWNERS + 1).count() <= MAX_BROADCAST_OWNERS
    width = F.broadcast(width) if few else width
    cell = lambda c: F.expr(f"`{c}` div __width - IF(`{c}` % __width < 0, 1, 0)")  # noqa: E731  rounded down, for positions of any size
    cut = some.join(width, owner).withColumn("__cell", F.explode(F.sequence(cell(first), cell(last)))).select(owner, "__cell", *names)
    return table.join(width, owner).withColumn("__cell", cell(at)).drop("__width"), cut


def interval_join(table: DataFrame, members: DataFrame, owner: str, at: str, first: str, last: str) -> DataFrame:
    """Rows of ``table`` with each member (owner, first, last; both ends inclusive) that contains them; members may overlap.

    An owner's positions are cut into cells of one width, chosen so that its members cover CELLS_PER_MEMBER cells
    on average, however their lengths differ: so members become at most 2 + CELLS_PER_MEMBER rows each on average (LEAST_CELLS times
    that for an owner of one), a row meets only members that reach its cell, and an owner that holds
    most rows is as many keys of the join as it has cells.
    """
    rows, cut = interval_cells(table, members, owner, at, first, last)
    return rows.join(cut, [owner, "__cell"]).where(F.col(at).between(F.col(first), F.col(last))).drop("__cell")


def excluded(table: DataFrame, exclusion: DataFrame, key: str = "feature_idx") -> DataFrame:
    """Policy view: rows whose key isn't on the blocklist. Spark broadcasts the list if its size allows."""
    return table.join(exclusion.select(key).distinct(), key, "left_anti")


# The read surfaces: fixed values of the data model -------------------------------------------------

#: Columns that a request may filter on.
FILTERS = ("feature_idx", "parent_feature_idx", "annotation_idx", "reference_idx", "node_index", "mask_idx", "prep_sample_idx", "alignment_idx")
#: Columns of a read, and those of an alignment that coverage and feature tables need.
READ_COLUMNS = ("prep_sample_idx", "sequence_idx", "read_id", "sequence1", "qual1", "sequence2", "qual2")
ALIGNMENT_COLUMNS = ("prep_sample_idx", "sequence_idx", "feature_idx", "flags", "position", "stop_position")
SURFACES = {
    "reference_sequences": Surface(FILTERS),
    "reference_sequence_chunks": Surface(FILTERS),
    "reference_taxonomy_visible": Surface(FILTERS),
    "reference_phylogeny": Surface(FILTERS),
    "reference_placements": Surface(FILTERS),
    "reference_annotation": Surface(FILTERS),
    "read_masked": Surface(FILTERS, needs_filter=True),
    "alignment_visible": Surface(FILTERS, ALIGNMENT_COLUMNS, needs_filter=True, single=("alignment_idx",)),
    "read_block": Surface((), READ_COLUMNS),
    "read_masked_block": Surface(("mask_idx",), READ_COLUMNS, needs_filter=True, single=("mask_idx",)),
}
#: Surfaces that are blocks: asked for by members only.
BLOCKS = ("read_block", "read_masked_block")
#: Tables without a reference_idx of their own; the membership table says whose their features are.
BY_MEMBERSHIP = ("reference_sequences", "reference_sequence_chunks")

Tables = Callable[[str], DataFrame]


def relation(tables: Tables, surface: str) -> DataFrame:
    """What a surface reads: a table, or the policy view over it."""
    from .masks import masked

    if surface == "reference_taxonomy_visible":
        return excluded(tables("reference_taxonomy"), tables("reference_exclusion"))
    if surface == "alignment_visible":
        return excluded(tables("alignment"), tables("reference_exclusion"))
    if surface in ("read_masked", "read_masked_block"):
        return masked(tables("read"), tables("read_mask"))
    return tables("read" if surface == "read_block" else surface)


def fetch(tables: Tables, surface: str, where: Mapping[str, Sequence[int]] | None = None, members: Sequence[tuple[int, int, int]] = ()) -> DataFrame:
    """The rows of a surface under ``column IN values`` filters, or of a block of members.

    ``tables`` gives a lake table by name (``Lake.read`` does). Refused: unknown surfaces and filter
    columns, members where there is no block, a block without members, reads or alignments without a
    filter, alignments of several runs, a masked block without exactly one mask. A reference_idx of a
    table that has none joins the membership; a feature in two of the references comes twice.
    """
    where = dict(where or {})
    if surface not in SURFACES:
        raise SliceError(f"{surface}: not a surface")
    if surface in BLOCKS and not members:
        raise SliceError(f"{surface}: no members")
    if surface not in BLOCKS and members:
        raise SliceError(f"{surface}: takes no members")
    table = relation(tables, surface)
    if surface in BLOCKS:
        return build(block(table, members, "prep_sample_idx", "sequence_idx"), SURFACES[surface], where)
    if surface in BY_MEMBERSHIP and "reference_idx" in where:
        table = scoped(table, tables("reference_membership"), "feature_idx", "reference_idx", where.pop("reference_idx"))
    for column in where:
        if column in FILTERS and column not in table.columns:
            raise SliceError(f"{surface}: has no {column}")
    return build(table, SURFACES[surface], where)
