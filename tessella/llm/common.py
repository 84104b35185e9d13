"""What the operators of this subpackage share: the shared folder, cut lineage, range buckets."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which ends its lineage: a lost
    executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` has written, once nothing reads them again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for sessions whose PYTHONPATH lacks it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    sc._tessella_shipped = True
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def fold_case(c: Column) -> Column:
    """Lower case for A-Z alone, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounds_below(bounds: list, key: Column, kind: str = "bigint") -> Column:
    """How many of the sorted bounds are at most key, by binary search in a higher-order function:
    the number of the range that key falls into. The list is literal, so its length must be bounded."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    arr = F.expr(f"array({', '.join(f'cast({b} as {kind})' for b in bounds)})")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])

    def step(pos: Column, s: Column) -> Column:
        return F.when((pos + s <= n) & (F.get(arr, pos + s - 1) <= key), pos + s).otherwise(pos)

    return F.aggregate(steps, F.lit(0), step)


def spread_alike(rows: DataFrame, like: str, usual: int) -> DataFrame:
    """rows, a written table with the number of the part it came from (__part), with __sub: 0, but the part's number plus 1 for
    rows whose value of `like` occurs more than `usual` times. Rows alike can be dealt by it, and as any of them serves in any
    place, results don't depend on the parts. There are fewer such values than rows / usual."""
    hot = sorted(r[like] for r in rows.groupBy(like).count().filter(F.col("count") > usual).select(like).collect())
    if not hot:
        return rows.withColumn("__sub", F.lit(0))
    spark = rows.sparkSession
    table = spark.createDataFrame([(h, 1) for h in hot], f"{like} bigint, __hot int")
    return rows.join(F.broadcast(table), like, "left").withColumn("__sub", F.when(F.col("__hot") == 1, F.col("__part") + 1).otherwise(F.lit(0))).drop("__hot")


#: Bounds in one literal list, at most; more are looked up in two steps.
LITERAL_BOUNDS = 256


def with_range(df: DataFrame, bounds: list[int], key: str, name: str) -> DataFrame:
    """Adds the number of the range that an integer column falls into. Up to LITERAL_BOUNDS sorted bounds are
    searched as a literal list; of more, every so many are, and the bounds between two of them come from
    a table of 16 bytes a bound that goes to all tasks, so expressions don't grow with the bounds."""
    if len(bounds) <= LITERAL_BOUNDS:
        return df.withColumn(name, bounds_below(bounds, F.col(key)))
    step = -(-len(bounds) // LITERAL_BOUNDS)
    heads = bounds[step - 1 :: step]
    rows = [(i, i * step, bounds[i * step : (i + 1) * step]) for i in range(len(heads) + 1)]
    table = df.sparkSession.createDataFrame(rows, "__part int, __from int, __bounds array<bigint>")
    df = df.withColumn("__part", bounds_below(heads, F.col(key))).join(F.broadcast(table), "__part")
    within = F.size(F.filter("__bounds", lambda b: b <= F.col(key)))
    return df.withColumn(name, F.col("__from") + within).drop("__part", "__from", "__bounds")


def range_bounds(df: DataFrame, key: str, n: int, each: int = 50) -> list[int]:
    """At most n-1 cut points that split the integer key into ranges of about equal counts of keys: quantiles
    of a sample of about `each` distinct keys per range, drawn by the key's hash. Cut points only deal out
    the work."""
    if n < 2:
        return []
    rate = max(1, df.count() // (n * each))
    keys = sorted(r[0] for r in df.select(key).filter(F.pmod(F.xxhash64(key), F.lit(rate)) == 0).distinct().collect())
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
