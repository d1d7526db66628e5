"""A batch source of JSON lines under a pinned revision, for hubs that are mirrored in a folder.

spark.dataSource.register(PinnedRows); spark.read.format("pinned_rows")
    .option("root", ...).option("revision", ...).schema(...).load()
There is one partition for each file, read line by line.
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, root: str, revision: str, names: list[str]):
        self.folder, self.names = os.path.join(root, revision), names

    def partitions(self):
        if not os.path.isdir(self.folder):
            raise ValueError(f"no such revision: {self.folder}")
        files = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.folder) for f in fs if f.endswith(".jsonl"))
        return [_File(f) for f in files]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)


class PinnedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pinned_rows"

    def schema(self) -> str:
        raise ValueError("give the rows' schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        missing = [k for k in ("root", "revision") if k not in self.options]
        if missing:
            raise ValueError(f"options missing: {', '.join(missing)}")
        return _Reader(self.options["root"], self.options["revision"], [f.name for f in schema.fields])
