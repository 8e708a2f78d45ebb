"""A data source for the solver's native array files, where their reader is installed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, dataset string, kind string, width int, shape array<bigint>, block bigint, values array<double>"


class NativeArrays(DataSource):
    """spark.read.format("native_arrays").load(files, separated by commas): one row for each block of each dataset. Without h5py it refuses to read, with a message that says so."""

    @classmethod
    def name(cls) -> str:
        return "native_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        try:
            import h5py  # noqa: F401
        except ImportError as e:
            raise RuntimeError("native array files need h5py, which is not installed; read their datasets from Parquet tables instead") from e
        return _Reader(self.options.get("path", ""), int(self.options.get("blockRows", "65536")))


class _Reader(DataSourceReader):
    def __init__(self, paths: str, block_rows: int):
        self.paths, self.block_rows = [p for p in paths.split(",") if p], block_rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import h5py
        import numpy as np

        with h5py.File(partition.value.removeprefix("file://"), "r") as file:
            names: list[str] = []
            file.visititems(lambda name, item: names.append(name) if isinstance(item, h5py.Dataset) else None)
            for name in names:
                data = file[name]
                if data.dtype.kind not in "iuf":
                    continue
                rows = data.shape[0] if data.ndim else 1
                for block, at in enumerate(range(0, rows, self.block_rows)):
                    part = data[at : at + self.block_rows] if data.ndim else data[()]
                    yield partition.value, name, data.dtype.kind, data.dtype.itemsize, list(data.shape), block, np.asarray(part, dtype=float).ravel().tolist()
