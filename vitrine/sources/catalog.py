"""The catalog table: merge on read over bucketed delta files.

    rows/src=<s>/v=<o>/k=row|seen/b=<k>/   bucketed parquet
    _log/source=<s>/v=<n>[.full], c=<n>    what counts
    _meta/buckets=<n>                      number of id buckets

A run writes only what it changes: new, changed and removed products as wide
rows (``k=row``; a removed one is an id marked ``gone``), products it merely saw
again as ``(id, last_seen_run)`` (``k=seen``: the other columns are null and cost
nothing). A read takes, for every id, the newest wide row and the newest sighting.

Files are bucketed by a hash of the id, as an external bucketed table, so Spark
knows their partitioning: newest-wins and the merge with a run's rows need no
exchange of the stored side, only the run's rows are dealt to the same buckets. When
a bucket of a source has collected ``COMPACT_AFTER`` deltas, its live rows are
written once more in one piece, and reads of it start there; other buckets keep
their files.

A delta counts only once its entry in ``_log`` exists, and a run numbered ``n``
always merges into the state below ``n``: a replayed run or micro-batch first
removes what it had written, then writes the same again. The root must be a
folder that driver and executors share; one writer of a table at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.records import CATALOG_SCHEMA, accepted, pad_columns

_VERSION = re.compile(r"^v=(\d+)(\.full)?$")
_COMPACT = re.compile(r"^c=(\d+)$")
_SOURCE = re.compile(r"^source=(.*)$")
RESERVED = "_batches"      # which version a stream's micro-batch writes
BUCKETS = 8                # id buckets of a new table
COMPACT_AFTER = 10         # deltas of a bucket that are folded into one piece
_COLUMNS = [f.name for f in CATALOG_SCHEMA.fields]


class CatalogTable:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """Opens the table at ``root``; ``buckets`` counts only where there is none yet."""
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = [int(n.split("=")[1]) for n in self._list(f"{self.root}/_meta") if n.startswith("buckets=")]
        self.buckets = known[0] if known else buckets
        if not known:
            self._mkdirs(f"{self.root}/_meta/buckets={buckets}")
        self._name = "vitrine_catalog_" + hashlib.md5(self.root.encode()).hexdigest()[:16]

    # ------------------------------------------------------------ layout
    def _list(self, path: str) -> list[str]:
        p = self._Path(path)
        if not self._fs.exists(p):
            return []
        return [st.getPath().getName() for st in self._fs.listStatus(p) if st.isDirectory()]

    @staticmethod
    def _must(done: bool, what: str) -> None:
        if not done:
            raise OSError(f"catalog: could not {what}")

    def _mkdirs(self, path: str) -> None:
        self._must(self._fs.mkdirs(self._Path(path)), f"make {path}")

    def _remove(self, path: str) -> None:
        if self._fs.exists(self._Path(path)):
            self._must(self._fs.delete(self._Path(path), True), f"remove {path}")

    def _log(self, source: str) -> str:
        return f"{self.root}/_log/source={quote(source, safe='')}"

    def _data_dirs(self) -> dict[str, str]:
        """source -> its folder under ``rows`` (as Spark escapes it)."""
        return {unquote(n[len("src="):]): f"{self.root}/rows/{n}" for n in self._list(f"{self.root}/rows") if n.startswith("src=")}

    def _committed(self, source: str) -> list[int]:
        return sorted(int(m.group(1)) for m in map(_VERSION.match, self._list(self._log(source))) if m)

    def sources(self) -> list[str]:
        return sorted(unquote(m.group(1)) for m in (_SOURCE.match(n) for n in self._list(f"{self.root}/_log")) if m)

    def versions(self) -> list[int]:
        """Every committed version number over all sources."""
        return sorted({v for s in self.sources() for v in self._committed(s)})

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def snapshot(self, below: int | None = None, sources: list[str] | None = None) -> dict[str, int]:
        """Per source, the newest committed version (``< below`` when given)."""
        out = {}
        for s in sources if sources is not None else self.sources():
            vs = [v for v in self._committed(s) if below is None or v < below]
            if vs:
                out[s] = vs[-1]
        return out

    def next_free(self) -> int:
        """A version number above every committed or reserved one."""
        taken = self.versions()
        reserved = f"{self.root}/{RESERVED}"
        for stream in self._list(reserved):
            for batch in self._list(f"{reserved}/{stream}"):
                taken += [int(m.group(1)) for m in map(_VERSION.match, self._list(f"{reserved}/{stream}/{batch}")) if m]
        return max(taken, default=0) + 1

    def reserve(self, stream: str, batch: int) -> int:
        """The version of a stream's batch: a new one at first, the same one
        when the batch is replayed. ``stream`` names the stream's progress
        (its checkpoint). One writer of a table at a time, as for commits."""
        place = f"{self.root}/{RESERVED}/{quote(stream, safe='')}/{batch}"
        found = [int(m.group(1)) for m in map(_VERSION.match, self._list(place)) if m]
        if found:
            return found[0]
        version = self.next_free()
        self._mkdirs(f"{place}/v={version:06d}")
        return version

    # ------------------------------------------------------------- state
    # Files of version n carry v = 2n, its compaction v = 2n + 1.

    def _entries(self, source: str, last: int) -> tuple[list[int], dict[int, int]]:
        """(orders, start): the committed ``v`` of a source up to ``last``, and for
        each bucket the ``v`` from which on its files count."""
        orders, starts = [], []
        for name in self._list(self._log(source)):
            if m := _VERSION.match(name):
                orders.append(2 * int(m.group(1)))
                if m.group(2):
                    starts.append((orders[-1], range(self.buckets)))
            elif m := _COMPACT.match(name):
                orders.append(2 * int(m.group(1)) + 1)
                starts.append((orders[-1], [int(b[2:]) for b in self._list(f"{self._log(source)}/{name}") if b.startswith("b=")]))
        start = dict.fromkeys(range(self.buckets), -1)
        for order, buckets in sorted(starts, key=lambda x: x[0]):
            if order <= last:
                start.update(dict.fromkeys(buckets, order))
        return sorted(o for o in orders if o <= last), start

    def _counts(self, source: str, last: int, only: list[int] | None = None) -> Column | None:
        """Partition predicate of a source's files that count; None: there are none."""
        orders, start = self._entries(source, last)
        groups: dict[int, list[int]] = {}
        for b, o in start.items():
            if only is None or b in only:
                groups.setdefault(o, []).append(b)
        out = None
        for o, buckets in groups.items():
            own = [x for x in orders if x >= o]
            if own:
                term = F.col("v").isin(own)
                if len(buckets) < self.buckets:
                    term = term & F.col("b").isin(buckets)
                out = term if out is None else out | term
        return None if out is None else (F.col("src") == source) & out

    # -------------------------------------------------------------- read
    def _table(self) -> DataFrame:
        """The files as a bucketed table of this session."""
        if not self.spark.catalog.tableExists(self._name):
            key = "spark.sql.hive.manageFilesourcePartitions"   # partitions are what the folder holds
            before = self.spark.conf.get(key)
            self.spark.conf.set(key, "false")
            try:
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CATALOG_SCHEMA.fields)
                self._mkdirs(f"{self.root}/rows")
                place = f"{self.root}/rows".replace("'", "\\'")
                self.spark.sql(f"CREATE TABLE {self._name} ({columns}, gone boolean, src string, v bigint, k string, b int) USING parquet "
                               f"PARTITIONED BY (src, v, k, b) CLUSTERED BY (id) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            finally:
                self.spark.conf.set(key, before)
        return self.spark.table(self._name)

    def _read(self, last: int | None, sources: list[str] | None = None, only: list[int] | None = None) -> DataFrame:
        limit = 2 * max(self.versions(), default=0) + 1 if last is None else last
        wanted = [c for c in (self._counts(s, limit, only) for s in (self.sources() if sources is None else sources)) if c is not None]
        if not wanted:
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        self._table()
        self.spark.catalog.refreshTable(self._name)   # another session may have written
        where = wanted[0]
        for c in wanted[1:]:
            where = where | c
        files = self._table().where(where)
        row = F.struct(*[c for c in _COLUMNS], "gone", "v")
        # one pass over both kinds, by the layout's own partitioning (no exchange)
        newest = files.groupBy("id").agg(F.max_by(row, F.when(F.col("k") == "row", F.col("v"))).alias("r"),
                                         F.max(F.when(F.col("k") == "seen", F.struct("v", "last_seen_run"))).alias("s"))
        live = newest.where("r is not null and not coalesce(r.gone, false)")
        last_seen = F.when(F.col("s.v") > F.col("r.v"), F.col("s.last_seen_run")).otherwise(F.col("r.last_seen_run"))
        return live.select("id", *[last_seen.alias(c) if c == "last_seen_run" else F.col(f"r.{c}").alias(c) for c in _COLUMNS if c != "id"])

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table as of ``version`` (default: latest)."""
        return self._read(None if version is None else 2 * version + 1)

    def read_base(self, version: int, sources: list[str] | None = None) -> DataFrame:
        """What run ``version`` merges into: the state below it."""
        return self._read(2 * version - 1, sources)

    def scan_source(self, source: str, version: int | None = None) -> DataFrame:
        """S3: one source's rows with a non-empty url, one per url. Only that
        source's folder is read (pruning by layout)."""
        from vitrine.operators.dedupe import keep_last

        df = self._read(None if version is None else 2 * version + 1, [source])
        return keep_last(df.where(F.coalesce(F.col("product_url"), F.lit("")) != ""), ["product_url"], ["updated_at", "id"])

    def history(self) -> DataFrame:
        """``source, version, kind, n``: how many wide rows (``row``), removals
        (``gone``) and sightings (``seen``) every committed run wrote."""
        done = [(s, 2 * v) for s in self.sources() for v in self._committed(s)]
        if not done:
            return self.spark.createDataFrame([], "source string, version int, kind string, n long")
        self._table()
        self.spark.catalog.refreshTable(self._name)
        committed = self.spark.createDataFrame(done, "src string, v long")
        kind = F.when(F.col("gone"), "gone").otherwise(F.col("k"))
        counts = self._table().where("v % 2 = 0").groupBy("src", "v", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        return counts.join(F.broadcast(committed), ["src", "v"]).select(
            F.col("src").alias("source"), (F.col("v") / 2).cast("int").alias("version"), "kind", "n")

    # ------------------------------------------------------------- write
    def _append(self, rows: DataFrame, order: int) -> None:
        """Writes ``rows`` (catalog columns, ``gone``, ``k``) as files of ``v = order``."""
        self._table()
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG_SCHEMA.fields], F.col("gone").cast("boolean"),
                          F.col("source").alias("src"), F.lit(order).cast("bigint").alias("v"), "k",
                          F.pmod(F.hash("id"), F.lit(self.buckets)).alias("b"))
        out.repartition(self.buckets, "id").write.mode("append").insertInto(self._name)

    def _written(self, order: int) -> dict[str, str]:
        """source -> folder of the files of ``v = order``."""
        return {s: f"{d}/v={order}" for s, d in self._data_dirs().items() if self._fs.exists(self._Path(f"{d}/v={order}"))}

    def _commit(self, rows: DataFrame, version: int, sources: list[str], mark: str) -> int:
        for s in sources:                             # replay: what this version wrote before goes first
            for name in (f"v={version:06d}", f"v={version:06d}.full", f"c={version:06d}"):
                self._remove(f"{self._log(s)}/{name}")
        for order in (2 * version, 2 * version + 1):
            for s, path in self._written(order).items():
                if s in sources or version not in self._committed(s):
                    self._remove(path)
        self._append(rows, 2 * version)
        strange = {s: path for s, path in self._written(2 * version).items() if s not in sources and version not in self._committed(s)}
        if strange:
            for path in self._written(2 * version).values():
                self._remove(path)
            raise ValueError(f"rows of sources that this commit does not name: {sorted(strange)[:5]}")
        for s in sources:
            self._mkdirs(f"{self._log(s)}/v={version:06d}{mark}")
        return version

    def commit(self, rows: DataFrame, version: int, sources: list[str]) -> int:
        """Write ``rows`` as the whole content of ``sources`` from version
        ``version`` on (a source may be left without rows). Rows of any other
        source, or of none, are an error: nothing is committed then."""
        whole = pad_columns(rows).withColumns({"gone": F.lit(False), "k": F.lit("row")})
        return self._commit(whole, version, sources, ".full")

    def commit_changes(self, merged: DataFrame, version: int, sources: list[str]) -> int:
        """Write what a run changed, from `merge_catalog` with marks:
        ``write`` is ``row`` (the row as it is now), ``seen`` (only its last_seen_run moved)
        , ``gone`` (removed) or null (nothing to write)."""
        kind = F.col("write")
        narrow = {"id", "source", "last_seen_run"}
        rows = pad_columns(merged).where(kind.isNotNull()).select(
            *[F.col(c) if c in narrow else F.when(kind == "row", F.col(c)).alias(c) for c in _COLUMNS],
            (kind == "gone").alias("gone"), F.when(kind == "seen", "seen").otherwise("row").alias("k"))
        self._commit(rows, version, sources, "")
        for s in sources:
            self.compact(s, version)
        return version

    def compact(self, source: str, version: int, after: int | None = None) -> list[int]:
        """Folds the buckets of a source that hold ``after`` deltas or more into one
        piece each, as of ``version``; returns them. Reads give the same rows."""
        after = COMPACT_AFTER if after is None else after
        orders, start = self._entries(source, 2 * version + 1)
        later = [o for o in orders if o > min(start.values())]
        folder = self._data_dirs().get(source)
        if folder is None or len(later) < after:
            return []
        deltas = dict.fromkeys(range(self.buckets), 0)
        for o in later:
            held = {int(b[2:]) for k in ("row", "seen") for b in self._list(f"{folder}/v={o}/k={k}") if b.startswith("b=")}
            for b in held:
                deltas[b] += o > start[b]
        due = [b for b, n in deltas.items() if n >= after]
        if due:
            order = 2 * version + 1
            rows = self._read(2 * version, [source], due).withColumns({"gone": F.lit(False), "k": F.lit("row")})
            self._append(rows, order)
            place = f"{self.root}/_staging-{uuid.uuid4().hex[:8]}"
            for b in due:
                self._mkdirs(f"{place}/b={b}")
            self._must(self._fs.rename(self._Path(place), self._Path(f"{self._log(source)}/c={version:06d}")), "commit a compaction")
        return due


def touched_sources(rows: DataFrame) -> list[str]:
    """Distinct sources of a run's rows: one per configured shop, tiny."""
    return sorted(r[0] for r in rows.select("source").where(F.trim("source") != "").distinct().collect())


def upsert(table: CatalogTable, incoming: DataFrame, run: int, run_ts: str | None = None,
           expire: bool = True, sources: list[str] | None = None, exact_sources: bool = False,
           sighted: DataFrame | None = None) -> DataFrame:
    """Merge formatted rows into the sources they touch and commit
    version ``run`` of those sources only; only changes are written. Returns the
    merged rows with action.

    ``sources``: sources this run covers beside those of its rows (a site whose
    rows are all missing still gets a version). Every accepted row is stored,
    whether its source is listed or not; rejected rows never are.
    ``exact_sources``: the rows have no others, so they need not be looked for.
    ``sighted``: ``id, source`` of products, apart from those of ``incoming``, that
    were seen without anything new; what is not in the table stays out."""
    from pyspark import StorageLevel

    from vitrine.operators.merge import merge_catalog

    if exact_sources:
        rows, srcs = incoming, sorted(sources or ())
    else:
        rows = incoming.persist(StorageLevel.MEMORY_AND_DISK)   # read for its sources, then by the merge
        srcs = sorted({*(sources or ()), *touched_sources(rows)})
    merged = merge_catalog(table.read_base(run, srcs), rows, run, run_ts, expire, marks=True, buckets=table.buckets)
    changes = merged
    if sighted is not None:
        marks = {"last_seen_run": F.lit(run), "write": F.lit("seen")}
        changes = merged.unionByName(sighted.select("id", "source").withColumns(marks), allowMissingColumns=True)
    table.commit_changes(changes, run, srcs)
    if not exact_sources:
        rows.unpersist()
    return merged.drop("write")


def delete_products(table: CatalogTable, keys: DataFrame, version: int) -> int:
    """Remove rows by ``(source, product_url)``; only the removed ids are
    written, as ``gone``. Returns the number of rows removed."""
    from vitrine.operators.merge import matched_keys

    srcs = touched_sources(keys)
    doomed = matched_keys(table.read_base(version, srcs), keys)
    removed = doomed.count()
    table.commit_changes(doomed.withColumn("write", F.lit("gone")), version, srcs)
    return removed


def write_dead_letter(rows: DataFrame, root: str, run: int) -> None:
    """Rows that could not be written, as JSON lines per run."""
    rows.where(F.col("reject_reason").isNotNull()).write.mode("overwrite").json(f"{root}/run={run:06d}")


def append_run_log(summary: DataFrame, root: str) -> None:
    """Append the one-row run summary to the run log table."""
    summary.write.mode("append").parquet(root)


__all__ = ["CatalogTable", "upsert", "delete_products", "write_dead_letter", "append_run_log", "accepted"]
