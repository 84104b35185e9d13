"""Tables, record files, id lists and the shared folder."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder where it is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _store(spark: SparkSession, path: str):
    """A path and its own file system, so any store that Spark reads will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _store(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _store(spark, old)
    if not fs.rename(p, _store(spark, new)[1]):
        raise OSError(f"{old} can't become {new}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: later steps read the table instead of running df
    again, also after a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` has written, once nothing reads them again."""
    for t in tables:
        fs, p = _store(t.sparkSession, t.written_to)
        fs.delete(p, True)


def stored(spark: SparkSession, folder: str, ending: str = ".parquet") -> list[str]:
    """Names of the tables that a folder holds."""
    fs, p = _store(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n.removesuffix(ending) for n in names if n.endswith(ending))


def sweep(spark: SparkSession, folder: str, older_than: float = 3600.0) -> list[str]:
    """Deletes what in a folder wasn't changed for so many seconds, such as tables of runs that ended early;
    returns their names. Not for a folder that a running job may still read from."""
    fs, p = _store(spark, folder)
    now, gone = time.time(), []
    for x in fs.listStatus(p) if fs.exists(p) else []:
        if now - x.getModificationTime() / 1000 > older_than:
            fs.delete(x.getPath(), True)
            gone.append(x.getPath().getName())
    return sorted(gone)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a JSON-lines file or folder; a missing one is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def id_list(spark: SparkSession, path: str, name: str = "asset_id") -> DataFrame:
    """Distinct non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "").distinct()


def write_json_lines(df: DataFrame, path: str, resume: bool = False) -> None:
    df.write.mode("append" if resume else "overwrite").json(path)


def publish(df: DataFrame, folder: str, batch: str | int) -> bool:
    """Writes df as JSON lines into folder/batch=<batch>, once: a batch that is there already changes nothing. Returns
    whether this call published it.

    Tasks write into a staging folder of this call. When all have succeeded, the driver adds the result line and renames the
    folder, so a batch appears whole with its result line or not at all; what a failed call has staged is
    deleted, and readers never look there. With the batch id of foreachBatch a stream's rows are published exactly once."""
    spark = df.sparkSession
    target = f"{folder.rstrip('/')}/batch={batch}"
    if exists(spark, target):
        return False
    stage = f"{folder.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    fs, staged = _store(spark, stage)
    seen = Observation()
    began = time.time()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(stage)
        line = json.dumps({"batch": str(batch), "rows": seen.get["rows"], "seconds": round(time.time() - began, 3)})
        out = fs.create(_store(spark, f"{stage}/_result.json")[1])
        out.write(bytearray((line + "\n").encode()))
        out.close()
        # A rename onto a folder that has appeared meanwhile would move this one into it.
        return False if fs.exists(_store(spark, target)[1]) else bool(fs.rename(staged, _store(spark, target)[1]))
    finally:
        fs.delete(staged, True)


def published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all published batches, with their batch."""
    if not exists(spark, folder) or not _batches(spark, folder):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    return spark.read.schema(f"{schema}, batch string").json(folder)


def _batches(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _store(spark, folder)
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().startswith("batch=")) if fs.exists(p) else []


def result_lines(spark: SparkSession, folder: str) -> list[dict]:
    """The result line of each published batch."""
    out = []
    for b in _batches(spark, folder):
        fs, p = _store(spark, f"{b}/_result.json")
        stream = fs.open(p)
        out.append(json.loads(bytes(stream.readAllBytes()).decode()))
        stream.close()
    return out


def snapshot(df: DataFrame, folder: str, name: str) -> str:
    """A copy taken before a change; returns its path."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def undo_log(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key and old_<c> of the rows whose columns a change gives other values, or that it removes: written
    before the change, `undo` takes it back."""
    o = old.select(*key, F.struct(*columns).alias("o"))
    n = new.select(*key, F.struct(*columns).alias("n"))
    return o.join(n, key, "left").filter(~F.col("o").eqNullSafe(F.col("n"))).select(*key, *[F.col("o")[c].alias(f"old_{c}") for c in columns])


def undo(new: DataFrame, log: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The logged columns as they were; rows that the change added or left alone stay as they are."""
    back = new.join(log.withColumn("__hit", F.lit(True)), key, "left")
    return back.withColumns({c: F.when(F.col("__hit"), F.col(f"old_{c}")).otherwise(F.col(c)) for c in columns}).select(*new.columns)


def binary_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)


#: Bytes of a file that a task holds at once.
CHUNK = 1 << 20


def large_file_digests(files: DataFrame) -> DataFrame:
    """path, byte_size, sha256, error of files (path), of any size: each file is read in chunks from its own store by one task, which
    holds a chunk and the digest's state. A file that can't be read gets an error instead. Paths are dealt by their hash."""

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    fs, at = pa_fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")
                    state, size = hashlib.sha256(), 0
                    with fs.open_input_stream(at) as f:
                        while chunk := f.read(CHUNK):
                            state.update(chunk)
                            size += len(chunk)
                    rows.append((path, size, state.hexdigest(), None))
                except (OSError, ValueError, TypeError, AttributeError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "byte_size", "sha256", "error"])

    tasks = 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(tasks, "path").mapInArrow(run, "path string, byte_size bigint, sha256 string, error string")


def file_digests(files: DataFrame) -> DataFrame:
    """Of files whose content is a column, each below 2 GB; see `large_file_digests`."""
    return files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def first_existing(wanted: DataFrame, *candidates: DataFrame, on: str = "asset_id", value: str = "path") -> DataFrame:
    """For each wanted key the value of the first candidate table that has it, else null; of several values in
    one table the least."""
    out = wanted
    for i, c in enumerate(candidates):
        out = out.join(c.groupBy(on).agg(F.min(value).alias(f"__{i}")), on, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"__{i}") for i in range(len(candidates))])).drop(*[f"__{i}" for i in range(len(candidates))])


def constants(spark: SparkSession, rows: dict, key: str, columns: str) -> DataFrame:
    """A small constant dimension, such as city -> (province, latitude, longitude)."""
    return spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in rows.items()], f"{key} string, {columns}")


#: Rows of a dimension that is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_PLACES = 100_000


def placed(geo: DataFrame, cities: DataFrame) -> DataFrame:
    """geo (province, city, ...) with lat and lon of its city, or, where the city is blank or unknown, of the first
    city of its province (least lat, lon); null where neither is known."""
    known = cities.groupBy("province", "city").agg(F.min(F.struct("lat", "lon")).alias("__city"))
    capital = cities.groupBy("province").agg(F.min(F.struct("lat", "lon")).alias("__province"))
    few = cities.count() <= BROADCAST_PLACES
    known, capital = (F.broadcast(x) if few else x for x in (known, capital))
    out = geo.join(known, ["province", "city"], "left").join(capital, "province", "left").withColumn("__at", F.coalesce("__city", "__province"))
    return out.select(*geo.columns, "__at.lat", "__at.lon")


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A report table of a small result; limit is the report's length."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
