"""The crawl's durable state and small driver-side files, through Hadoop's file systems so that any store works."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkweb.operators.frontier import QUEUE

RECORDS = "seq BIGINT, url STRING, content STRING, crawled_at STRING, data STRING, hash STRING, extra MAP<STRING,STRING>, file STRING"

#: Logs of the queue and their columns.
LOGS = {
    "found": "seq BIGINT, url STRING, referrer STRING, depth INT",
    "outcomes": "seq BIGINT, file STRING, status INT, error STRING, skipped STRING",
    "dropped": "seq BIGINT",
}
STATES = ("crawled", "error", "skipped", "pending")
#: Tables of one tier that are merged to one of the next; rows of a bucket, about.
FAN, BUCKET_ROWS = 8, 1 << 20


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = _at(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(text.encode("utf-8", "surrogatepass")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None if there is none."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def load_json(spark: SparkSession, path: str, fallback=None):
    """The value of a JSON file; the fallback only if there is no file."""
    text = read_text(spark, path)
    return fallback if text is None else json.loads(text)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def prune(spark: SparkSession, directory: str, keep: set[str]) -> list[str]:
    """Delete the files under ``directory`` that aren't kept; what went."""
    fs, place = _at(spark, directory)
    if not fs.exists(place):
        return []
    kept = {_at(spark, k)[0].makeQualified(_at(spark, k)[1]).toString() for k in keep}
    found, gone = fs.listFiles(place, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.toString() not in kept and not path.getName().endswith(".crc"):
            fs.delete(path, False)
            gone.append(path.toString())
    return gone


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a text in place of a file's at once: written beside it, then renamed over it."""
    beside = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    place = _at(spark, path)[0].makeQualified(_at(spark, path)[1])
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(_at(spark, beside)[0].makeQualified(_at(spark, beside)[1]), place, overwrite)


def join_parts(spark: SparkSession, folder: str, path: str, first: str, cut: int, last: str) -> None:
    """Put the part files of a folder one after the other into the file ``path``: ``first`` before them, and ``last`` in
    place of their last ``cut`` bytes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, place = _at(spark, folder)
    parts = sorted((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(place) if s.getPath().getName().startswith("part-") and s.getLen())
    out_fs, out_path = _at(spark, path)
    out = out_fs.create(out_path, True)
    out.write(bytearray(first.encode()))
    for k, (_, part, size) in enumerate(parts):
        stream = fs.open(part)
        # Copied in the JVM; a part is longer than what is cut of the last one.
        jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size - (cut if k + 1 == len(parts) else 0))
        stream.close()
    out.write(bytearray(last.encode()))
    out.close()


class Store:
    """The queue as a log of facts, and record batches, under one directory.

    What was found (a row for each place in the queue), what came of it and which places were given up are only ever
    added, so a wave writes as many rows as it touched. Tables of one size are merged to a larger one, FAN at a time: a
    row is rewritten as often as the logarithm of the number of waves. Larger tables of what was found are bucketed by
    URL, so that looking up URLs never shuffles them.

    A small pointer file names the tables, the batches and the counts that belong together. It is swapped last, so a
    crawl that is cut off anywhere, in a merge as well, finds the last complete wave and nothing of the one after it.
    """

    def __init__(self, spark: SparkSession, storage: dict) -> None:
        self.spark, self.queue_dir, self.crawled_dir = spark, storage["queue_path"], storage["crawled_dir"]

    def current(self) -> dict:
        """Tables by log with rows and tier, record batches, states' counts, the next place and the last file's number.
        Every place before ``pending_from`` is settled; ``due`` names the table of hosts that have to wait."""
        text = read_text(self.spark, f"{self.queue_dir}/CURRENT")
        return json.loads(text) if text else {**{log: [] for log in LOGS}, "records": [], "counts": dict.fromkeys(STATES, 0), "next": 0, "files": 0, "pending_from": 0, "due": None}

    # --- tables of the log ---

    def _add(self, log: str, rows: DataFrame, tier: int = 0, size: int = 0) -> dict:
        """Write a table of a log. Where ``size`` rows fill several buckets it is bucketed."""
        name, buckets = f"silkweb_{uuid.uuid4().hex}", 1
        while log == "found" and size > buckets * BUCKET_ROWS:
            buckets *= 2
        place = f"{self.queue_dir}/{name}"
        if buckets == 1:
            rows.write.parquet(place)
        else:
            rows.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").option("path", place).saveAsTable(name)
        return {"name": name, "tier": tier, "buckets": buckets}

    def _table(self, log: str, made: dict) -> DataFrame:
        place = f"{self.queue_dir}/{made['name']}"
        if made["buckets"] == 1:
            return self.spark.read.schema(LOGS[log]).parquet(place)
        if not self.spark.catalog.tableExists(made["name"]):  # a session that takes up another's crawl
            self.spark.sql(f"CREATE TABLE {made['name']} ({LOGS[log]}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {made['buckets']} BUCKETS LOCATION '{place}'")
        return self.spark.table(made["name"])

    def _drop(self, made: dict) -> None:
        if made["buckets"] > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {made['name']}")
        delete(self.spark, f"{self.queue_dir}/{made['name']}")

    def log(self, log: str, now: dict | None = None) -> DataFrame:
        """All rows of a log: found, outcomes or dropped."""
        tables = [self._table(log, made) for made in (now or self.current())[log]]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], LOGS[log])

    def append(self, found: DataFrame | None = None, outcomes: DataFrame | None = None, dropped: DataFrame | None = None, batch: str | None = None, change: dict | None = None, due: DataFrame | None = None, **marks: int) -> None:
        """Add rows to the logs and a batch to the records, all at once. ``change`` is added to the states' counts, and
        ``marks`` replace next, files and pending_from, ``due`` (host, due) the hosts' due times."""
        now = self.current()
        waited = now.get("due")
        for log, rows in (("found", found), ("outcomes", outcomes), ("dropped", dropped)):
            if rows is not None:
                kinds = [x.split() for x in LOGS[log].split(", ")]
                now[log].append(self._add(log, rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds])))
        now["records"] += [batch] if batch else []
        for state, n in (change or {}).items():
            now["counts"][state] += n
        if due is not None:
            now["due"] = f"due-{uuid.uuid4().hex}"
            due.select("host", "due").write.parquet(f"{self.queue_dir}/{now['due']}")
        now |= marks
        self._swap(now)
        if due is not None and waited:
            delete(self.spark, f"{self.queue_dir}/{waited}")
        self.merge()

    def _swap(self, now: dict) -> None:
        swap_text(self.spark, f"{self.queue_dir}/CURRENT", json.dumps(now))

    def merge(self) -> None:
        """Put FAN tables of one tier together, as long as a log has so many. The old ones go after the pointer's swap."""
        while True:
            now = self.current()
            log, tier = next(((log, t) for log in LOGS for t in range(64) if sum(m["tier"] == t for m in now[log]) >= FAN), (None, 0))
            if log is None:
                return
            old = [m for m in now[log] if m["tier"] == tier]
            rows = self.log(log, {log: old})
            rows = rows.coalesce(max(1, self.spark.sparkContext.defaultParallelism))
            made = self._add(log, rows, tier + 1, rows.count() if log == "found" else 0)
            now[log] = [m for m in now[log] if m["tier"] != tier] + [made]
            self._swap(now)
            for m in old:
                self._drop(m)

    # --- the queue ---

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose URL the queue doesn't have. The rows are shuffled to the tables' buckets, the tables stay."""
        for made in sorted(self.current()["found"], key=lambda m: -m["buckets"]):
            rows = rows.join(self._table("found", made).select("url"), "url", "left_anti")
        return rows

    def pending(self) -> DataFrame:
        """Places of the queue without outcome: of the logs, only what lies behind the settled part is looked at."""
        now = self.current()
        behind = F.col("seq") >= now["pending_from"]
        rows = self.log("found", now).where(behind).join(self.log("outcomes", now).where(behind).select("seq"), "seq", "left_anti")
        return rows.join(self.log("dropped", now).where(behind), "seq", "left_anti") if now["dropped"] else rows

    def due(self) -> DataFrame | None:
        """Hosts with the epoch milliseconds before which they aren't asked again, as of the last wave."""
        named = self.current().get("due")
        return None if named is None else self.spark.read.schema("host STRING, due BIGINT").parquet(f"{self.queue_dir}/{named}")

    def queue(self) -> DataFrame:
        """Every place of the queue with what came of it."""
        now = self.current()
        places = self.log("found", now)
        if now["dropped"]:
            places = places.join(self.log("dropped", now), "seq", "left_anti")
        outcome = self.log("outcomes", now)
        names = [x.split()[0] for x in QUEUE.split(", ")]
        return places.join(outcome, "seq", "left").select(*names)

    # --- records ---

    def add_records(self, records: DataFrame) -> str:
        """Write a batch of records; they count once ``append`` names the batch that is returned."""
        batch = f"r-{uuid.uuid4().hex}"
        records.write.parquet(f"{self.crawled_dir}/{batch}")
        return batch

    def records(self) -> DataFrame:
        """Records with their place in the queue."""
        batches = self.current()["records"]
        if not batches:
            return self.spark.createDataFrame([], RECORDS)
        return self.spark.read.schema(RECORDS).parquet(*[f"{self.crawled_dir}/{b}" for b in batches])

    def reset(self) -> None:
        now = self.current()
        for log in LOGS:
            for made in now[log]:
                self._drop(made)
        delete(self.spark, self.queue_dir)
        delete(self.spark, self.crawled_dir)
