"""Sinks: a keyed table with upserts and deletes, and CSV export."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """Rows by key in a folder that driver and executors share: a change writes its own rows alone, and a read puts changes over the base.

    `log/<number>.json` names what a change wrote: rows with `_deleted`, true for keys that went. A number is taken by a rename that fails
    where the name is taken (at once on HDFS; a local file system looks first), so that a writer that comes second takes the next number
    and no change is lost. A change that fails half-way has no number, and isn't seen. The last change of a key counts; a null key is a
    key like any other. `compact` writes a new base, which covers the changes up to a number; later ones still lie over it.

    `batch`, the name of a stream and its batch's number, makes a replayed batch one that does nothing.
    """

    #: Changes that lie over a base before an upsert compacts.
    CHANGES = 32

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = spark.createDataFrame([], f"{schema}, _deleted boolean").schema
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.system = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        stream = self.system.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def log(self) -> list[dict]:
        """The entries in order: number, data, base, covers, stream, batch, streams."""
        at = self.path(f"{self.folder}/log")
        names = sorted(f.getPath().getName() for f in self.system.listStatus(at)) if self.system.exists(at) else []
        return [json.loads(self._text(f"{self.folder}/log/{n}")) | {"number": int(n.removesuffix(".json"))} for n in names if n[0].isdigit()]

    @staticmethod
    def _state(log: list[dict]) -> tuple[str | None, list[dict], dict[str, int]]:
        """The newest base, the changes over it, and the last batch of each stream."""
        bases = [x for x in log if x["base"]]
        base = max(bases, key=lambda x: x["covers"], default={"covers": 0, "data": None})
        streams: dict[str, int] = {}
        for x in log:
            for name, n in (x["streams"] | ({x["stream"]: x["batch"]} if x["stream"] else {})).items():
                streams[name] = max(n, streams.get(name, -1))
        return base["data"], [x for x in log if not x["base"] and x["number"] > base["covers"]], streams

    def _publish(self, entry: dict) -> bool:
        """Gives the entry the next number that is free; False if meanwhile its batch was published by another."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            log = self.log()
            if entry["stream"] and self._state(log)[2].get(entry["stream"], -1) >= entry["batch"]:
                return False
            number = max((x["number"] for x in log), default=0) + 1
            new = self.path(f"{self.folder}/log/_new.{uuid.uuid4().hex}")
            out = self.system.create(new)
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
            try:
                context.rename(new, self.path(f"{self.folder}/log/{number:012d}.json"), none)
                return True
            except Py4JJavaError as e:
                self.system.delete(new, False)
                if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                    raise

    def _write(self, rows: DataFrame) -> str:
        data = f"{self.folder}/data-{uuid.uuid4().hex}"
        rows.hint("rebalance").write.option("compression", "zstd").parquet(data)
        return data

    def _same(self, a: str, b: str) -> Column:
        return reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys])

    def rows(self) -> DataFrame:
        return self._rows(self.log())

    def _rows(self, log: list[dict]) -> DataFrame:
        data, changes, _ = self._state(log)
        base = self.spark.read.schema(self.schema).parquet(data) if data else self.spark.createDataFrame([], self.schema)
        if not changes:
            return base
        read = [self.spark.read.schema(self.stored).parquet(x["data"]).withColumn("_number", F.lit(x["number"])) for x in changes]
        last = reduce(DataFrame.unionByName, read).groupBy(*self.keys).agg(F.max_by(F.struct(*self.stored.names), "_number").alias("row")).select("row.*")
        kept = base.alias("a").join(last.select(*self.keys).alias("b"), self._same("a", "b"), "left_anti")
        return kept.unionByName(last.filter("not _deleted").drop("_deleted"))

    def upsert(self, incoming: DataFrame, order: list[Column], batch: tuple[str, int] | None = None) -> None:
        """Rows of incoming replace those with equal keys; of several incoming ones with one key the first by order (the last write) wins."""
        stream, number = batch or (None, -1)
        log = self.log()
        if stream and self._state(log)[2].get(stream, -1) >= number:
            return
        w = Window.partitionBy(*self.keys).orderBy(*order)
        last = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*self.schema.names, F.lit(False).alias("_deleted"))
        data = self._write(last)
        if not self._publish({"data": data, "base": False, "covers": 0, "stream": stream, "batch": number, "streams": {}}):
            self.system.delete(self.path(data), True)
        if len(self._state(log)[1]) >= self.CHANGES:
            self.compact()

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows with the given keys; returns how many there were. The table is read once; what is written is the keys that went."""
        gone = self.rows().alias("a").join(keys.select(*self.keys).distinct().alias("b"), self._same("a", "b"), "left_semi").withColumn("_deleted", F.lit(True))
        data = self._write(gone.select(*[F.col(c) if c in self.keys or c == "_deleted" else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.stored.names]))
        self._publish({"data": data, "base": False, "covers": 0, "stream": None, "batch": -1, "streams": {}})
        return self.spark.read.schema(self.stored).parquet(data).count()

    def compact(self) -> None:
        """Writes all rows as a new base; changes that others publish meanwhile lie over it."""
        log = self.log()
        if self._state(log)[1]:
            self._publish({"data": self._write(self._rows(log)), "base": True, "covers": log[-1]["number"], "stream": None, "batch": -1, "streams": self._state(log)[2]})

    def vacuum(self) -> None:
        """Removes entries that the newest base covers, and their files; for when nobody reads an older state."""
        log = self.log()
        held, changes, _ = self._state(log)
        used = {held, *(x["data"] for x in changes)}
        for x in log:
            if x["data"] not in used:
                self.system.delete(self.path(f"{self.folder}/log/{x['number']:012d}.json"), False)
                self.system.delete(self.path(x["data"]), True)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV files with a header line each; every cell is quoted, quotes are doubled, nulls are empty cells."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    df.select(*cells).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
