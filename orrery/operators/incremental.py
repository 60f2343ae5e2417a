"""Processing only new or changed records (problem 2).

A run rereads the source from the oldest transaction that was open at the last run, so that rows that became visible
late are seen again, and removes the overlap by an anti-join against a ledger of what was processed. A version may come
back (A, B, A): with a time each change is a record of its own, without one the ledger's last version of a key counts.
Output and ledger of a batch become visible together, by the creation of one marker file.

Defined results: a null key is no record; a null or blank version means the content is unknown and the record is left
out; repeated rows count once; of rows with the same time the greatest tie-break wins; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.paths import canonical_hash, canonical_path


def latest(df: DataFrame, key: str, order: list[Column], version: str) -> DataFrame:
    """(key, version) of the last row of each key. One max over a struct: combined before the shuffle, so a hot key is harmless."""
    return (
        df.where(F.col(key).isNotNull() & F.col(version).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(version).alias("version"))).alias("top"))
        .select(key, F.col("top.version").alias(version))
    )


def inside_windows(df: DataFrame, at: str, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose time lies inside a window, both ends included.

    Windows are cut into days and joined on the day, so no side is compared with all of the other.
    """
    days = (
        windows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
        .select(F.col(start).alias("__from"), F.col(end).alias("__to"))
        .distinct()
        .withColumn("__day", F.explode(F.sequence(F.to_date("__from"), F.to_date("__to"))))
    )
    keyed = df.withColumn("__at_day", F.to_date(at))
    met = (F.col("__at_day") == F.col("__day")) & (F.col(at) >= F.col("__from")) & (F.col(at) <= F.col("__to"))
    return keyed.join(days, met, "left_semi").drop("__at_day")


def changed_pairs(current: DataFrame, ledger: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version) pairs of `current` that the ledger lacks."""
    return current.join(ledger.select(key, version), [key, version], "left_anti")


def low_water_mark(runs: DataFrame) -> DataFrame:
    """One row: `reread_from`, the start of the oldest run that was open when the last sound run ended.

    A run is open at a time if it began before and had not ended. Without a sound run it is null: read everything.
    """
    last = runs.where(F.col("status") == "ok").agg(F.max("finished_at").alias("__last"))
    open_then = runs.crossJoin(F.broadcast(last)).where(  # one row: a scalar, no product
        (F.col("started_at") <= F.col("__last")) & (F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("__last")))
    )
    return open_then.agg(F.min("started_at").alias("reread_from"))


class IncrementalProcessor:
    """Runs `transform` over the records that no committed batch holds, each exactly once, even if runs die.

    Layout below `root`: `out/KEY` and `ledger/KEY`, where KEY is new for each attempt, and the marker `commits/N` with the
    KEY, which comes last, by one rename that fails where N is taken. So of two runs at once one wins, the other's folders
    are never read, and those of a run that died aren't either. The file system has to have such a rename, as HDFS has.
    `snapshots/N` names a folder with the ledger of all batches up to N.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, version: str):
        self.spark, self.root, self.key, self.version = spark, root.rstrip("/"), key, version
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)

    def _path(self, p: str):
        return self._hadoop.Path(p)

    def _marks(self, what: str) -> dict[int, str]:
        """Number -> KEY of the markers below `what`; bounded by the number of runs."""
        folder = self._path(f"{self.root}/{what}")
        if not self._fs.exists(folder):
            return {}
        out = {}
        for s in self._fs.listStatus(folder):
            if s.getPath().getName().isdigit():
                stream = self._fs.open(s.getPath())
                out[int(s.getPath().getName())] = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
        return out

    def _mark(self, what: str, n: int, key: str) -> None:
        """Fails if another run has marked n."""
        self._fs.mkdirs(self._path(f"{self.root}/{what}"))
        written = self._path(f"{self.root}/{what}/_{key}")
        stream = self._fs.create(written, False)
        stream.write(bytearray(key.encode()))
        stream.close()
        keep = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        keep[0] = self._hadoop.Options.Rename.NONE
        try:
            self._context.rename(written, self._path(f"{self.root}/{what}/{n}"), keep)
        finally:
            self._fs.delete(written, False)

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        return sorted(self._marks("commits"))

    def ledger(self) -> DataFrame | None:
        """(key, version, batch), and for batches run with a time also __at and __timed."""
        done, shots = self._marks("commits"), self._marks("snapshots")
        last = max(shots, default=-1)
        folders = ([f"{self.root}/ledger/{shots[last]}"] if shots else []) + [f"{self.root}/ledger/{k}" for n, k in sorted(done.items()) if n > last]
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def output(self, batch: int | None = None) -> DataFrame | None:
        """What the committed batches gave, or one of them."""
        folders = [f"{self.root}/out/{k}" for n, k in sorted(self._marks("commits").items()) if (batch is None or n == batch) and self._fs.exists(self._path(f"{self.root}/out/{k}"))]
        return self.spark.read.parquet(*folders) if folders else None

    def compact(self) -> None:
        """Write the ledger of all committed batches into one folder, so that later runs read that and what follows."""
        done, ledger = self.batches(), self.ledger()
        if ledger is None or done[-1] in self._marks("snapshots"):
            return
        key = uuid.uuid4().hex
        ledger.distinct().write.parquet(f"{self.root}/ledger/{key}")
        self._mark("snapshots", done[-1], key)

    def adopt(self, processed: DataFrame, at: str | None = None) -> int:
        """Commit a batch of (key, version) that another process is known to have processed; it has no output."""
        return self._commit(processed, at, uuid.uuid4().hex, self._next())

    def _next(self) -> int:
        return max(self._marks("commits"), default=-1) + 1

    def _commit(self, processed: DataFrame, at: str | None, key: str, n: int) -> int:
        timed = [] if at is None else [F.col(at).alias("__at"), F.lit(True).alias("__timed")]
        processed.select(self.key, self.version, F.lit(n).alias("batch"), *timed).write.parquet(f"{self.root}/ledger/{key}")
        self._mark("commits", n, key)
        return n

    def pending(self, source: DataFrame, at: str | None = None, reread_from=None) -> DataFrame:
        """Rows to process.

        With `at`: from the reread point on, one per (key, version, at), those whose version is not that of the row before
        in time, in the source or in the ledger, and that the ledger lacks. What was processed without a time counts as
        processed at any time. Without `at`: one per (key, version) that the ledger lacks; and where the source has one
        version of a key only, so that this is its state, also if the last batch with this key had another.
        """
        pair = [self.key, self.version]
        rows = source.where(F.col(self.key).isNotNull() & F.col(self.version).isNotNull())
        ledger = self.ledger()
        if at is None:
            rows = rows.dropDuplicates(pair)
            return rows if ledger is None else rows.join(self._unseen(rows, ledger), pair, "left_semi")
        if reread_from is not None:
            rows = rows.where(F.col(at) >= F.lit(reread_from))
        rows = rows.dropDuplicates([*pair, at])
        story = rows.select(*pair, F.col(at).alias("__at"), F.lit(0).alias("__old"))
        if ledger is not None and "__timed" in ledger.columns:
            story = story.unionByName(ledger.where("__timed").select(*pair, "__at", F.lit(1).alias("__old")))
        before = F.lag(self.version).over(Window.partitionBy(self.key).orderBy(F.col("__at").asc_nulls_first(), self.version))
        story = story.groupBy(*pair, "__at").agg(F.max("__old").alias("__old")).withColumn("__before", before)
        fresh = story.where((F.col("__old") == 0) & ~F.col("__before").eqNullSafe(F.col(self.version)))
        if ledger is not None:
            untimed = ledger.where(F.col("__timed").isNull()) if "__timed" in ledger.columns else ledger
            fresh = fresh.join(untimed.select(*pair), pair, "left_anti")
        fresh = fresh.select(F.col(self.key).alias("__key"), F.col(self.version).alias("__version"), "__at")
        return rows.join(fresh, (F.col(self.key) == F.col("__key")) & (F.col(self.version) == F.col("__version")) & F.col(at).eqNullSafe(F.col("__at")), "left_semi")

    def _unseen(self, rows: DataFrame, ledger: DataFrame) -> DataFrame:
        """(key, version) of the distinct `rows` that the ledger lacks or that came back."""
        pair = [self.key, self.version]
        last = ledger.groupBy(self.key, "batch").agg(F.min(self.version).alias("lo"), F.max(self.version).alias("hi")).groupBy(self.key).agg(F.max(F.struct("batch", "lo", "hi")).alias("last"))
        state = rows.groupBy(self.key).agg(F.min(self.version).alias(self.version), F.count(F.lit(1)).alias("n")).where("n = 1")
        back = state.join(last, self.key).where((F.col("last.lo") != F.col(self.version)) | (F.col("last.hi") != F.col(self.version)))
        return changed_pairs(rows, ledger, self.key, self.version).select(*pair).unionByName(back.select(*pair))

    def run(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda d: d, at: str | None = None, reread_from=None) -> int:
        """Process what is pending and commit it; returns the batch number. Of two runs at once, the later one to commit fails."""
        n, key = self._next(), uuid.uuid4().hex  # the number is taken before the ledger is read
        staged = f"{self.root}/staged/{key}"
        try:
            self.pending(source, at, reread_from).write.parquet(staged)
            batch = self.spark.read.parquet(staged)
            transform(batch).write.parquet(f"{self.root}/out/{key}")
            return self._commit(batch, at, key, n)
        finally:
            self._fs.delete(self._path(staged), True)


def changed_files(listing: DataFrame, hashes: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """Files whose current content differs from what the last sound run left: (file_path, content_hash, listed_at).

    One run of the processor below `root`. Its ledger begins with what the sound runs left of each file. The listing is
    read again from the oldest run on that was open when the last sound one ended; a file without a row since then is
    taken by its last row before, so none is passed over. The anti-join with the ledger removes what was processed.
    """
    tidy = lambda df, *extra: df.select(canonical_path(F.col("file_path")).alias("file_path"), canonical_hash(F.col("content_hash")).alias("content_hash"), *extra)
    sound = inside_windows(tidy(hashes, "indexed_at"), "indexed_at", runs.where(F.col("status") == "ok"), "started_at", "finished_at")
    work = IncrementalProcessor(listing.sparkSession, root, "file_path", "content_hash")
    work.adopt(latest(sound, "file_path", [F.col("indexed_at")], "content_hash"))
    mark = low_water_mark(runs).first().reread_from
    rows = tidy(listing, "listed_at", "listing_id").where(F.col("file_path").isNotNull() & F.col("content_hash").isNotNull())
    again = F.lit(True) if mark is None else F.coalesce(F.col("listed_at") >= F.lit(mark), F.lit(False))
    order = F.struct(again.alias("again"), "listed_at", "listing_id", "content_hash")
    current = rows.groupBy("file_path").agg(F.max(order).alias("top")).select("file_path", "top.content_hash", "top.listed_at")
    return work.output(work.run(current))
