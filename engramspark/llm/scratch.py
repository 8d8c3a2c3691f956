"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..lineage import shared_folder

_SHIPPED = "_engram_shipped"
_BATCH, _DEFAULT, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that workers can import it without a shared path. Texts go
    to Python in batches of ROWS_AT_ONCE, unless the session says otherwise."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, ROWS_AT_ONCE)
    if getattr(sc, _SHIPPED, False):
        return
    setattr(sc, _SHIPPED, True)
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="engram-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for name in ("__init__.py", "lineage.py"):
            z.write(package / name, f"{package.name}/{name}")
        for p in sorted((package / "llm").glob("*.py")):
            z.write(p, f"{package.name}/llm/{p.name}")
    sc.addPyFile(archive)


_open: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Gives back the disk of all scratch tables that were made inside; what is returned from inside must not read them any more."""
    _open.append([])
    try:
        yield
    finally:
        for made in _open.pop():
            made.close()


class Scratch:
    """A folder of Parquet tables for one run of an operator. A lost executor costs only the tasks it ran: every
    table is complete in the shared folder before the next step reads it. Removed when the process ends, by drop(), or at the end of temporary()."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/engram-{uuid.uuid4().hex}"
        atexit.register(self.close)
        if _open:
            _open[-1].append(self)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        self._remove(self.root)

    def drop(self, name: str) -> None:
        """Give back the disk of a table that nothing reads any more."""
        self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may be gone at exit
            pass
