"""An incrementally kept table of sessions.

``apply`` takes a batch of events, makes the batch's own sessions, finds stored
sessions within the gap of any of them, merges bridged ones and replaces the rows
concerned. The table is a folder of Parquet parts, one per era (a stretch of the
calendar) and bucket of owners. A batch reads and rewrites only the parts that its
events reach, and becomes visible when the manifest that names the live parts is
renamed into place. Readers see the table before or after a batch, never between. A
batch that was cut off leaves unreferenced files and no other trace, and can be applied
again. Parts that no kept version names any more are deleted.

Redeliveries. Event ids of every batch stay in a ledger. An event delivered before lies
inside a stored session, as deliveries agree in owner and time; so only events that do
are looked up, and the ledger itself is never shuffled while they are few.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenloom.operators.intervals import DAY, heads, slice_of
from listenloom.runtime import discard, hadoop_fs, materialize, remove

_SESSIONS = "owner string, start bigint, stop bigint, n bigint"
_LEDGER = "event_id bigint, owner string, slice int, start bigint"
#: Sessions a part should hold, from which the number of buckets is taken.
PART_SESSIONS = 1_000_000
#: Folders of the ledger that are merged into one.
FANOUT = 16
#: Lookups that are broadcast; more are joined by a shuffle.
FEW = 500_000


class SessionTable:
    """Sessions of ``gap`` seconds under ``path``.

    ``buckets`` parts by hash of the owner in each era of ``era_seconds``; without it the
    first batch that holds events decides (:data:`PART_SESSIONS` to a part), so give it for
    a table that starts small. ``slice_seconds`` must be above ``gap``. ``keep`` versions
    stay readable. Deliveries of one event id agree in owner and time.
    """

    def __init__(self, spark: SparkSession, path: str, gap: int = 1800, buckets: int | None = None, slice_seconds: int = DAY, era_seconds: int = 91 * DAY, keep: int = 2):
        if slice_seconds <= gap:
            raise ValueError("slice_seconds must be above gap")
        self.spark, self.path, self.gap, self.buckets, self.slice_seconds, self.era_seconds, self.keep = spark, path.rstrip("/"), gap, buckets, slice_seconds, era_seconds, max(1, keep)

    # manifest ---------------------------------------------------------------
    def _versions(self) -> dict[int, object]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/manifest")
        if not fs.exists(p):
            return {}
        return {int(f.getPath().getName()[:-5]): f.getPath() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")}

    def _load(self, path) -> dict:
        fs, _ = hadoop_fs(self.spark, self.path)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _manifest(self) -> dict:
        """The newest committed manifest: ``parts`` by "era:bucket" with folder and latest stop, ``ledger`` folders with their level."""
        known = self._versions()
        return self._load(known[max(known)]) if known else {"version": 0, "parts": {}, "ledger": []}

    def _commit(self, manifest: dict) -> None:
        """Rename into place; a second writer of the same version fails."""
        fs, staged = hadoop_fs(self.spark, f"{self.path}/manifest/{uuid.uuid4().hex}.tmp")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{manifest['version']:d}.json")
        if fs.exists(final) or not fs.rename(staged, final):
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    def _expire(self) -> None:
        """Delete versions beyond those kept, and the folders only they name."""
        known = self._versions()
        names = lambda m: {x["path"] for x in m["parts"].values()} | {x["path"] for x in m["ledger"]}
        old = sorted(known)[: -self.keep]
        if not old:
            return
        live = set().union(*(names(self._load(known[v])) for v in sorted(known)[-self.keep :]))
        root = lambda path: path.partition("/era=")[0]
        roots = {root(path) for path in live}
        for v in old:
            gone = names(self._load(known[v])) - live
            for path in {path if root(path) in roots else root(path) for path in gone}:
                remove(self.spark, path)
            remove(self.spark, known[v].toString())

    # reading ------------------------------------------------------------------
    def _read(self, folders: list[str], schema: str) -> DataFrame:
        """All folders in one scan."""
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def sessions(self) -> DataFrame:
        """``owner, start, stop, n`` of the newest version."""
        return self._read([x["path"] for x in self._manifest()["parts"].values()], _SESSIONS)

    # writing --------------------------------------------------------------------
    def _keys(self, buckets: int, at) -> list:
        return [F.floor(at / F.lit(self.era_seconds)).cast("int").alias("era"), F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int").alias("bucket")]

    def _reached(self, batch: DataFrame, manifest: dict, buckets: int) -> list[str]:
        """Keys of the stored parts that may hold a session within the gap of an event."""
        near = batch.select("owner", "start", F.explode(F.array(F.col("start") - self.gap, F.col("start") + self.gap)).alias("at"))
        touched = near.groupBy(*self._keys(buckets, F.col("at"))).agg(F.min("start").alias("low")).collect()  # at most a row per part
        keys = {(r.era, r.bucket) for r in touched}
        lows: dict[int, list[tuple[int, int]]] = {}
        for r in touched:
            lows.setdefault(r.bucket, []).append((r.era, r.low))
        found = []
        for key, part in manifest["parts"].items():
            era, bucket = map(int, key.split(":"))
            if (era, bucket) in keys or any(era < e and part["reach"] >= low - self.gap for e, low in lows.get(bucket, ())):
                found.append(key)
        return found

    def apply(self, events: DataFrame, owner: str = "user_id", ts: str = "ts", event_id: str = "play_id") -> int:
        """Apply one batch; returns the version that holds it.

        Rows with null owner, time or id are ignored, repeated ids count once, whether
        within a batch or across batches. An empty batch commits an unchanged table.
        """
        old, spark = self._manifest(), self.spark
        rows = events.select(F.col(f"`{event_id}`").cast("bigint").alias("event_id"), F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{ts}`").cast("bigint").alias("start")).where("event_id is not null and owner is not null and start is not null")
        folder = f"{self.path}/ledger/{uuid.uuid4().hex}"
        # in order of time, so that lookups skip row groups
        rows.withColumn("slice", slice_of(F.col("start"), self.slice_seconds)).sortWithinPartitions("slice").select("event_id", "owner", "slice", "start").write.parquet(folder)
        batch = self._read([folder], _LEDGER)
        buckets = old.get("buckets") or self.buckets
        if not buckets:
            buckets = self._buckets_for(batch)
        reached = self._reached(batch, old, buckets or 1) if old["parts"] else []
        stored = self._read([old["parts"][k]["path"] for k in reached], _SESSIONS)

        local = materialize(self._local(batch, stored if reached else None), "local")
        islands = local.where("event_id is null").select("owner", "start", "stop", "n")
        if reached:
            again = local.where("event_id is not null")
            islands = islands.unionByName(self._added(again, old["ledger"]))
        merged = heads(islands.unionByName(stored), self.gap, ["owner"])
        root, parts = f"{self.path}/parts/{uuid.uuid4().hex}", dict(old["parts"])
        if buckets:
            keyed = merged.select("*", *self._keys(buckets, F.col("start")))
            keyed.hint("rebalance", "era", "bucket").write.partitionBy("era", "bucket").parquet(root)
            new = spark.read.schema(_SESSIONS + ", era int, bucket int").parquet(root)
            for k in reached:
                del parts[k]
            for r in new.groupBy("era", "bucket").agg(F.max("stop").alias("reach")).collect():  # a row per part
                parts[f"{r.era}:{r.bucket}"] = {"path": f"{root}/era={r.era}/bucket={r.bucket}", "reach": r.reach}
        ledger, merged_away = self._compacted([*old["ledger"], {"path": folder, "level": 0}])
        manifest = {"version": old["version"] + 1, "parts": parts, "ledger": ledger, "buckets": buckets}
        self._commit(manifest)
        discard(local)
        named = {x["path"] for x in old["ledger"]}
        for path in merged_away:
            if path not in named:  # no version will ever name it
                remove(spark, path)
        self._expire()
        return manifest["version"]

    def _buckets_for(self, batch: DataFrame) -> int | None:
        """Buckets that give parts of about :data:`PART_SESSIONS` rows; a session starts at most once in ``gap`` seconds."""
        r = batch.select("owner", F.floor(F.col("start") / F.lit(self.era_seconds)).alias("era"), F.floor(F.col("start") / F.lit(self.gap + 1)).alias("k")).agg(F.approx_count_distinct(F.struct("owner", "k")).alias("most"), F.approx_count_distinct("era").alias("eras")).first()
        return max(1, min(4096, -(-r.most // (max(1, r.eras) * PART_SESSIONS)))) if r.most else None

    def _local(self, batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        """``owner, start, stop, n, event_id``: events outside stored sessions merged inside their slices, and, with their id, those inside.

        The latter have ``start`` and ``stop`` of the stored session they are in. One
        shuffle by owner and slice serves all of it.
        """
        s = self.slice_seconds
        lines = batch.select("owner", "slice", "start", F.lit(None).cast("bigint").alias("stop"), "event_id")
        if stored is not None:
            slices = F.sequence(F.floor(F.col("start") / F.lit(s)), F.floor(F.col("stop") / F.lit(s)))
            span = batch.agg(F.min("slice").alias("low"), F.max("slice").alias("high")).first()
            pieces = stored.select("owner", F.explode(F.transform(slices, lambda x: x.cast("int"))).alias("slice"), "start", "stop", F.lit(None).cast("bigint").alias("event_id"))
            lines = lines.unionByName(pieces.where(F.col("slice").between(span.low, span.high)))
        piece = F.when(F.col("stop").isNotNull(), F.col("start")).alias("piece")
        once = lines.repartition("owner", "slice").groupBy("owner", "slice", "event_id", piece, "stop").agg(F.min("start").alias("start")).drop("piece")
        w = Window.partitionBy("owner", "slice").orderBy("start", F.col("stop").desc_nulls_last())
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        event = F.col("stop").isNull()
        cover = F.last(F.when(~event, F.struct("start", "stop")), ignorenulls=True).over(upto)
        seen = once.withColumn("cover", cover).withColumn("inside", F.coalesce(event & (F.col("cover.stop") >= F.col("start")), F.lit(False)))
        before = F.last(F.when(event & ~F.col("inside"), F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(event & ~F.col("inside") & (before.isNull() | (F.col("start") - before > self.gap)), F.col("start"))
        headed = seen.withColumn("opens", opens).withColumn("head", F.last("opens", ignorenulls=True).over(upto)).where(event)
        inside = F.col("inside")
        keyed = headed.select("owner", "slice", F.when(inside, F.col("event_id")).alias("event_id"), F.when(~inside, F.col("head")).alias("head"), F.when(inside, F.col("cover.start")).otherwise(F.col("start")).alias("start"), F.when(inside, F.col("cover.stop")).otherwise(F.col("start")).alias("stop"))
        return keyed.groupBy("owner", "slice", "event_id", "head").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"))

    def _added(self, again: DataFrame, ledger: list[dict]) -> DataFrame:
        """Events inside stored sessions that weren't delivered before, added up by session."""
        r = again.agg(F.count("*").alias("n"), F.min("slice").alias("low"), F.max("slice").alias("high")).first()
        if not r.n:
            return again.select("owner", "start", "stop", "n").limit(0)
        asked = again.select("event_id")
        seen = self._read([x["path"] for x in ledger], _LEDGER).where(F.col("slice").between(r.low, r.high)).select("event_id")
        known = seen.join(F.broadcast(asked) if r.n <= FEW else asked, "event_id", "left_semi").distinct()
        return again.join(known, "event_id", "left_anti").groupBy("owner", "start", "stop").agg(F.sum("n").alias("n"))

    def _compacted(self, ledger: list[dict]) -> tuple[list[dict], list[str]]:
        """The ledger with every :data:`FANOUT` folders of one level merged into one of the next, so that an id is rewritten few times; and the folders merged."""
        level, gone = 0, []
        while any(x["level"] >= level for x in ledger):
            same = [x for x in ledger if x["level"] == level]
            if len(same) >= FANOUT:
                folder = f"{self.path}/ledger/{uuid.uuid4().hex}"
                rows = self._read([x["path"] for x in same], _LEDGER)
                rows.repartitionByRange("slice", "event_id").sortWithinPartitions("slice").write.parquet(folder)
                gone += [x["path"] for x in same]
                ledger = [x for x in ledger if x["level"] != level] + [{"path": folder, "level": level + 1}]
            level += 1
        return ledger, gone

    def drop(self) -> None:
        remove(self.spark, self.path)
