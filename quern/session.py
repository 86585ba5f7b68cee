"""Sessions, and tables written in the shared folder to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can reach.

    Only where it is unset, as in tests on one machine, a temporary folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"quern-shared-{os.getpid()}")
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables of one operator run, written as Parquet in the shared folder.

    A written table survives lost executors, cuts lineage, is computed once and is read column by column.
    Tables that later stages no longer need are dropped early; the rest go when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._remove, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(df._quern_path)  # type: ignore[attr-defined]

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session is gone already
            pass


class SharedFolder:
    """Small files in a folder on any file system that Spark's executors share, by Hadoop's file interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs_class = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._context = self._fs_class.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._fs_class.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Put the file in place in one step: readers see the old text or the new one."""
        tmp = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(tmp), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        how = self._fs_class.Options.Rename
        options = SparkContext._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        self._context.rename(self._path(tmp), self._path(name), options)

    def claim(self, name: str, text: str = "") -> bool:
        """Create the file if there is none; False if there is."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self) -> list[str]:
        return [status.getPath().getName() for status in self._fs.listStatus(self._path(""))]
