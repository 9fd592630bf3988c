"""A lake of Parquet files with numbered versions.

A version is one small file that lists, for each table, the files that make it up, with their rows and
the least and greatest value of each ``_idx`` column. A change reads one version, writes new files, then publishes the next
number by a rename that never replaces: of two writers one gets it, the other is told of the
conflict. Readers take the highest number, which is always complete, so they see all of a change or
none. Appending adds files to the list and deleting rewrites only the files that hold doomed
rows; no change rewrites a table. Reads of a block or of some owners open only files whose ranges meet
them. ``vacuum`` removes what no kept version lists and no writer holds a lease on.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cascades import Cascade, Link
from ..operators.slices import SliceError, block, block_condition, merged_members
from ..schemas import DDL, empty
from ..session import spelled

#: A lease that is older was left by a writer that died.
LEASE_SECONDS = 86_400
#: How often an append is published anew after another writer was faster.
RETRIES = 20


class Conflict(RuntimeError):
    """Another writer was faster."""


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions ------------------------------------------------------------------------------------

    def _statuses(self, folder: str) -> list:
        at = self._path(folder)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _listed(self, folder: str) -> list[str]:
        return [f.getPath().toString() for f in self._statuses(folder)]

    def version(self) -> int:
        """The highest published number; 0 before the first."""
        return max((int(p.rsplit("/", 1)[1]) for p in self._listed(f"{self.root}/_versions") if p.rsplit("/", 1)[1].isdigit()), default=0)

    def entries(self, version: int | None = None) -> dict[str, list[dict]]:
        """Table to its files: path, rows, and low and high of its keys."""
        v = self.version() if version is None else version
        if not v:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_versions/{v:020d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def contents(self, version: int | None = None) -> dict[str, list[str]]:
        """Table to its files."""
        return {t: [e["path"] for e in some] for t, some in self.entries(version).items()}

    def versions(self) -> dict[str, int]:
        """Table to the number of the lake's version, for those that it has."""
        v = self.version()
        return dict.fromkeys(self.entries(v), v)

    def _create(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, began: int, entries: dict[str, list[dict]]) -> None:
        part = f"{self.root}/_versions/_{uuid.uuid4().hex}"
        self._create(part, json.dumps(entries))
        target = self._fs.makeQualified(self._path(f"{self.root}/_versions/{began + 1:020d}"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            context.rename(self._fs.makeQualified(self._path(part)), target, options)
        except Exception as e:
            self._fs.delete(self._path(part), False)
            if self._fs.exists(target):
                raise Conflict("the lake changed meanwhile") from e
            raise

    # writing files -------------------------------------------------------------------------------

    def _leased(self, table: str) -> tuple[str, str]:
        """A new folder of ``table`` and the lease that keeps it from ``vacuum`` until its files are published."""
        name = uuid.uuid4().hex
        lease = f"{self.root}/_leases/{name}"
        self._create(lease, table)
        return f"{self.root}/{table}/{name}", lease

    def _release(self, leases: list[str]) -> None:
        for lease in leases:
            self._fs.delete(self._path(lease), False)

    def _described(self, folder: str, kind) -> list[dict]:
        """The entries of a folder's files; only keys are read. A file without rows is left out."""
        df = self.spark.read.schema(kind).parquet(folder)
        keys = [f.name for f in kind if f.name.endswith("_idx") and f.dataType.simpleString() in ("bigint", "int")]
        each = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *[g(k).alias(f"{n} {k}") for k in keys for n, g in (("low", F.min), ("high", F.max))])
        by = {r["file"]: r for r in each.collect()}  # a row for each new file
        out = []
        for status in self._statuses(folder):
            r = by.get(spelled(status.getPath().toUri().toString()))
            if r is not None:
                out.append({"path": status.getPath().toString(), "rows": r["rows"], "keys": {k: [r[f"low {k}"], r[f"high {k}"]] for k in keys}})
        return out

    def _written(self, table: str, df: DataFrame, leases: list[str]) -> list[dict]:
        at, lease = self._leased(table)
        leases.append(lease)
        df.write.option("compression", "zstd").parquet(at)
        return self._described(at, df.schema)

    # reading -------------------------------------------------------------------------------------

    def _frame(self, table: str, entries: list[dict]) -> DataFrame:
        """The files as one table, each under its own schema (files that were taken in may differ in the order of columns)."""
        if not entries:
            return empty(self.spark, table) if table in DDL else self.spark.createDataFrame([], "none int")
        return self.spark.read.option("mergeSchema", len(entries) > 1 and table not in DDL).parquet(*[e["path"] for e in entries])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._frame(table, self.entries(version).get(table, []))

    @staticmethod
    def _within(entries: list[dict], column: str, values: Sequence[int]) -> list[dict]:
        """The files whose range of ``column`` holds one of ``values``; files without a range count as holding any."""
        order = sorted(values)

        def meets(e: dict) -> bool:
            if column not in e["keys"]:
                return True
            low, high = e["keys"][column]
            return low is not None and bisect_left(order, low) < bisect_right(order, high)

        return [e for e in entries if meets(e)]

    @staticmethod
    def _meeting(entries: list[dict], members: Sequence[tuple[int, int, int]], owner: str, at: str) -> list[dict]:
        """The files whose ranges meet a member (owner, first, last)."""
        order = merged_members(members)
        owners = [m[0] for m in order]

        def meets(e: dict) -> bool:
            if owner not in e["keys"] or at not in e["keys"]:
                return True
            (low, high), (first, last) = e["keys"][owner], e["keys"][at]
            if low is None or first is None:
                return False
            return any(m[1] <= last and first <= m[2] for m in order[bisect_left(owners, low) : bisect_right(owners, high)])

        return [e for e in entries if meets(e)]

    def read_values(self, table: str, column: str, values: Sequence[int], version: int | None = None) -> DataFrame:
        """The rows whose ``column`` is one of ``values``, from the files that can hold them."""
        return self._frame(table, self._within(self.entries(version).get(table, []), column, values)).where(F.col(column).isin(list(values)))

    def read_block(self, table: str, members: Sequence[tuple[int, int, int]], owner: str = "prep_sample_idx", at: str = "sequence_idx", version: int | None = None) -> DataFrame:
        """The rows within the members (owner, first, last), from the files that can hold them, however many the table has."""
        return block(self._frame(table, self._meeting(self.entries(version).get(table, []), members, owner, at)), members, owner, at)

    # changing ------------------------------------------------------------------------------------

    def replace(self, tables: dict[str, DataFrame], began: dict[str, int] | None = None) -> dict[str, int]:
        """New contents of all ``tables``, in one change. Returns rows by table. ``began``: what ``versions`` said when the caller read."""
        v = self.version()
        entries, rows, leases = self.entries(v), {}, []
        if began is not None and began != dict.fromkeys(entries, v):
            raise Conflict("the lake changed meanwhile")
        try:
            for name, df in tables.items():
                entries[name] = self._written(name, df, leases)
                rows[name] = sum(e["rows"] for e in entries[name])
            self._publish(v, entries)
        finally:
            self._release(leases)
        return rows

    def _add(self, fresh: dict[str, list[dict]]) -> dict[str, int]:
        """Publish more files. It doesn't matter what else changed meanwhile, so a conflict only means another try."""
        for n in range(RETRIES):
            v = self.version()
            entries = self.entries(v)
            for name, some in fresh.items():
                entries[name] = [*entries.get(name, []), *some]
            try:
                self._publish(v, entries)
                break
            except Conflict:
                if n == RETRIES - 1:
                    raise
        return {name: sum(e["rows"] for e in some) for name, some in fresh.items()}

    def append(self, parts: dict[str, DataFrame]) -> dict[str, int]:
        """Add rows to several tables in one change; what they hold already stays where it is. Returns rows added."""
        leases: list[str] = []
        try:
            return self._add({name: self._written(name, df, leases) for name, df in parts.items()})
        finally:
            self._release(leases)

    def register(self, staged: dict[str, str]) -> dict[str, int]:
        """Move staged Parquet files into their tables, in one change; nothing is written again. Returns rows added.

        Paths that climb are refused, as are files without a column of their table, and a file never replaces another.
        If it fails before the change is published, the files go back.
        """
        if any(".." in p.split("/") for p in staged.values()):
            raise ValueError("a staged path may not climb")
        kinds = {}
        for name, p in staged.items():
            kinds[name] = self.spark.read.parquet(p).schema
            missing = set(empty(self.spark, name).columns) - set(kinds[name].names) if name in DDL else set()
            if missing:
                raise ValueError(f"{name}: staged files have no {', '.join(sorted(missing))}")
        moved, leases, fresh = [], [], {}
        try:
            for name, p in staged.items():
                at, lease = self._leased(name)
                leases.append(lease)
                self._fs.mkdirs(self._path(at))
                for f in [f for f in self._listed(p) if f.endswith(".parquet")]:
                    to = f"{at}/{f.rsplit('/', 1)[1]}"
                    if self._fs.exists(self._path(to)) or not self._fs.rename(self._path(f), self._path(to)):
                        raise OSError(f"{f}: could not be moved to {to}")
                    moved.append((f, to))
                fresh[name] = self._described(at, kinds[name])
            return self._add(fresh)
        except BaseException:
            for f, to in reversed(moved):
                self._fs.rename(self._path(to), self._path(f))
            raise
        finally:
            self._release(leases)

    def _delete(self, doomed: dict[str, Column | Callable[[DataFrame], DataFrame]], began: int | None = None, prune: Callable[[list[dict]], list[dict]] | None = None) -> dict[str, int]:
        """Rows deleted by table, in one change of version ``began``.

        ``doomed`` gives of each table a condition, or a function that selects the rows to go with all
        their columns. ``prune`` leaves the files that can hold such rows. Only files that do are
        rewritten; their names and counts come to the driver, the rows don't.
        """
        v = self.version() if began is None else began
        entries, counts, leases, changed = self.entries(v), {}, [], False
        place = (F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        try:
            for name, select in doomed.items():
                counts[name] = 0
                some = entries.get(name, [])
                some = prune(some) if prune else some
                if not some:
                    continue
                rows = self._frame(name, some)
                by_rule = isinstance(select, Column)
                if by_rule:
                    each = rows.groupBy(place[0]).agg(F.count_if(select).alias("n")).where("n > 0")
                else:
                    gone = select(rows.select("*", *place)).select("__file", "__row").distinct()
                    each = gone.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
                hit = {r["__file"]: r["n"] for r in each.collect()}  # a row for each touched file
                if not hit:
                    continue
                counts[name] = sum(hit.values())
                touched = [e for e in some if self._spelled(e["path"]) in hit]
                if len(touched) != len(hit):
                    raise RuntimeError(f"{name}: files of doomed rows aren't listed")
                old = self._frame(name, touched)
                if by_rule:
                    left = old.where(~F.coalesce(select, F.lit(False)))
                else:
                    left = old.select("*", *place).join(gone, ["__file", "__row"], "left_anti").drop("__file", "__row")
                keep = [e for e in entries[name] if e not in touched]
                whole = sum(e["rows"] for e in touched) == counts[name]  # nothing of these files is left to write
                entries[name] = keep if whole else [*keep, *self._written(name, left, leases)]
                changed = True
            if changed:
                self._publish(v, entries)
        finally:
            self._release(leases)
        return counts

    def _spelled(self, path: str) -> str:
        return spelled(self._fs.makeQualified(self._path(path)).toUri().toString())

    def delete(self, table: str, doomed: Callable[[DataFrame], DataFrame], keys: list[str]) -> int:
        """Delete the rows whose keys ``doomed`` selects; how many. Repeating it deletes nothing."""
        pick = lambda rows: rows.join(doomed(rows).select(*keys).distinct(), keys, "left_semi")
        return self._delete({table: pick})[table]

    def delete_where(self, table: str, condition: Column) -> int:
        """Delete the rows for which ``condition`` is true (null isn't)."""
        return self._delete({table: condition})[table]

    def _delete_values(self, tables: Sequence[str], column: str, values: Sequence[int]) -> dict[str, int]:
        return self._delete({t: F.col(column).isin(list(values)) for t in tables}, prune=lambda some: self._within(some, column, values))

    def delete_mask(self, mask_idx: int) -> int:
        return self._delete_values(["read_mask"], "mask_idx", [mask_idx])["read_mask"]

    def delete_alignment(self, alignment_idx: int) -> int:
        return self._delete_values(["alignment"], "alignment_idx", [alignment_idx])["alignment"]

    def delete_pool_reads(self, prep_sample_idxs: Sequence[int]) -> dict[str, int]:
        """Reads and masks of a pool's samples, in one change; no samples, no change."""
        if not prep_sample_idxs:
            return {"read": 0, "read_mask": 0}
        return self._delete_values(["read", "read_mask"], "prep_sample_idx", list(prep_sample_idxs))

    def delete_block(self, table: str, column: str, value: int, members: Sequence[tuple[int, int, int]]) -> int:
        """Rows of one mask or alignment within the members (sample, first, last): the footprint that a block read has. No members, no change."""
        if table not in ("read_mask", "alignment"):
            raise SliceError(f"{table}: has no blocks")
        if not merged_members(members):
            return 0
        inside = block_condition(members, "prep_sample_idx", "sequence_idx")
        own = F.col(column) == value
        doomed = own & inside if inside is not None else lambda rows: block(rows.where(own), members, "prep_sample_idx", "sequence_idx")
        return self._delete({table: doomed}, prune=lambda some: self._meeting(self._within(some, column, [value]), members, "prep_sample_idx", "sequence_idx"))[table]

    def delete_reference(self, reference_idx: int) -> dict[str, int]:
        """Rows of a reference in its own tables, and sequences and chunks of features that nothing else lists; counts by table, in one change.

        Rows without a reference_idx stay and keep the features they list.
        """
        v = self.version()  # the orphans are those of the version that is changed; a change in between is a conflict
        mine = F.col("reference_idx") == reference_idx
        rest = ~F.col("reference_idx").eqNullSafe(reference_idx)
        listed = [self.read(t, v) for t in ("reference_membership", "reference_annotation")]
        features = lambda part: listed[0].where(part).select("feature_idx").union(listed[1].where(part).select("feature_idx"))
        orphan = features(mine).subtract(features(rest))
        of_orphan = lambda rows: rows.join(orphan, "feature_idx", "left_semi")
        own = ("reference_taxonomy", "reference_phylogeny", "reference_membership", "reference_placements", "reference_annotation")
        return self._delete({t: of_orphan for t in ("reference_sequences", "reference_sequence_chunks")} | {t: mine for t in own}, v)

    def delete_graph(self, links: Sequence[Link], root: str, condition: Column) -> dict[str, int]:
        """Delete the rows of ``root`` that meet ``condition`` and, by ``links``, those that go with them, in one change of one version; rows by table.

        Rows that stay and forbid it make the change fail with nothing deleted, as does a change by another writer meanwhile. A name can't be unset here.
        """
        if any(x.action == "unset" for x in links):
            raise ValueError("a delete rewrites no values")
        v = self.version()
        tables = {t: self.read(t, v) for t in dict.fromkeys([root, *(x for link in links for x in (link.table, link.of, *(link.via or ())[:1]))])}
        plan = Cascade(tables, links, root, tables[root].where(condition))
        doomed: dict = {t: (lambda rows, t=t: plan.gone(t, rows)) for t in plan.counts if t != root}
        return self._delete(doomed | {root: condition}, v)

    def full_replace(self, table: str, rows: DataFrame) -> int:
        return self.replace({table: rows})[table]

    # upkeep --------------------------------------------------------------------------------------

    def vacuum(self, keep_seconds: float = 0, lease_seconds: float = LEASE_SECONDS) -> int:
        """Remove data and version files that nothing needs; how many.

        The newest version stays, as do those published in the last ``keep_seconds`` and all files that a version
        which stays lists: give it the time that a reader may take. A folder on which a writer holds a lease stays too: folders are listed
        before leases and leases before versions, so a writer that gave its lease back in between has published.
        """
        now = time.time()
        folders = [(f, self._listed(f)) for t in self._listed(self.root) if not t.rsplit("/", 1)[1].startswith("_") for f in self._listed(t)]
        leases = {f.getPath().getName(): f for f in self._statuses(f"{self.root}/_leases")}
        held = {n for n, f in leases.items() if now - f.getModificationTime() / 1000 < lease_seconds}
        v = self.version()
        if not v:
            return 0
        n, used = 0, set()
        for status in self._statuses(f"{self.root}/_versions"):
            name = status.getPath().getName()
            if name.isdigit() and (int(name) >= v or now - status.getModificationTime() / 1000 < keep_seconds):
                used |= {self._spelled(p) for paths in self.contents(int(name)).values() for p in paths}
            elif name.isdigit():
                n += self._fs.delete(status.getPath(), False)
        for name, status in leases.items():
            if name not in held:
                self._fs.delete(status.getPath(), False)
        for folder, files in folders:
            if folder.rsplit("/", 1)[1] in held or self._spelled(folder) in used:
                continue
            wanted = [f for f in files if self._spelled(f) in used]
            for f in [f for f in files if f not in wanted and f.endswith(".parquet")] if wanted else [folder]:
                n += self._fs.delete(self._path(f), True)
        return n
