"""Reader of .npy arrays: spark.read.format("npy").load(path).

The header gives shape and type; each partition maps its range of rows of the
file and sends them as Arrow batches.  Only one- and two-dimensional numeric
arrays in C order are read; row is the position in the file, or in the files of a
folder one after the other by name.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

ROWS = 1 << 20


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int, before: int):
        self.path, self.start, self.stop, self.before = path, start, stop, before


def _open(path: str) -> np.ndarray:
    array = np.load(path, mmap_mode="r", allow_pickle=False)
    if array.ndim not in (1, 2) or array.dtype.kind not in "iufb":
        raise ValueError(f"{path}: {array.ndim} dimensions of {array.dtype} can't be read")
    return array


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.rows = int(options.get("rows", ROWS))
        path = Path(options["path"])
        self.files = sorted(map(str, path.glob("*.npy"))) if path.is_dir() else [str(path)]

    def partitions(self) -> list[InputPartition]:
        parts, before = [], 0
        for f in self.files:
            n = len(_open(f))
            parts += [_Rows(f, k, min(k + self.rows, n), before) for k in range(0, n, self.rows)]
            before += n
        return parts

    def read(self, partition: _Rows):
        if partition is None:
            return
        array = _open(partition.path)
        for k in range(partition.start, partition.stop, 1 << 16):
            block = np.asarray(array[k : min(k + (1 << 16), partition.stop)])
            block = block.reshape(len(block), -1)
            whole = block.dtype.kind in "iub"
            columns = [pa.array(np.arange(k, k + len(block), dtype=np.int64) + partition.before)]
            columns += [pa.array(np.ascontiguousarray(c).astype(np.int64 if whole else np.float64)) for c in block.T]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        path = Path(self.options["path"])
        array = _open(str(sorted(path.glob("*.npy"))[0] if path.is_dir() else path))
        width = 1 if array.ndim == 1 else array.shape[1]
        kind = LongType() if array.dtype.kind in "iub" else DoubleType()
        names = ["value"] if array.ndim == 1 else [f"c{k}" for k in range(width)]
        return StructType([StructField("row", LongType()), *[StructField(n, kind) for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register_npy(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)
