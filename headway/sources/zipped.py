"""A data source for CSV tables in zip files: `spark.read.format("zipped_feed")`.

A partition is a member of a file. A task reads its member as it is unpacked and hands it on in batches, so that neither
a file nor a member is ever whole in memory. Equality filters are applied where rows are made.

Options: path, a file or several separated by commas; table; columns, separated by commas; optional, whether a file may lack the table.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

ROWS = 20_000


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__(name)
        self.path, self.name = path, name


def opened(path: str):
    """A readable, seekable file of any store that Arrow knows; a plain path is a local one."""
    store, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store.open_input_file(inner)


class ZippedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.table = options["path"].split(","), options["table"]
        self.columns, self.optional = options["columns"].split(","), options.get("optional", "false") == "true"
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], set(f.value) if isinstance(f, In) else {f.value}))
            else:
                yield f

    def partitions(self) -> list[Member]:
        found = []
        for path in self.paths:
            with opened(path) as file, zipfile.ZipFile(file) as z:
                held = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == f"{self.table}.txt"]
            if not held and not self.optional:
                raise FileNotFoundError(f"{self.table}.txt is not in {path}")
            found += [Member(path, n) for n in held]
        return found

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no member
            return
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
        with opened(partition.path) as file, zipfile.ZipFile(file) as z, z.open(partition.name) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), skipinitialspace=True)
            at = {name.strip(): k for k, name in enumerate(next(lines, []))}
            places, rows = [at.get(c) for c in self.columns], []
            checks = [(self.columns.index(c), values) for c, values in self.wanted]
            for line in lines:
                if not line:
                    continue
                row = [line[k].strip() or None if k is not None and k < len(line) else None for k in places]
                if all(row[k] in values for k, values in checks):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)


class ZippedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_feed"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> ZippedReader:
        return ZippedReader(dict(self.options))
