"""A data source of raw tiles: rows of 32-bit floats, little-endian and without a header, and beside each tile its rows' numbers.

A tile is two files, tile-<rows>-<least>-<most>-<its own name>.f32 and the same .i64: what a reader needs to know which tiles it
can leave out stands in the name. A partition is a tile; conditions on the rows' number `i` are pushed down, to tiles and to rows.
"""

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from krylake.plans.tables import importable

ROWS = 4096  # of a tile
SCHEMA = "i long, row array<float>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}")


class Tile(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.rows, self.least, self.most = (int(x) for x in name.split("-")[1:4])


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path, -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("i",) and isinstance(f.value, int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Tile]:
        where, folder = opened(self.path)
        names = sorted(f.base_name.removesuffix(".f32") for f in where.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".f32"))
        return [t for t in map(Tile, names) if t.most >= self.low and t.least <= self.high]

    def read(self, tile: Tile) -> Iterator[pa.RecordBatch]:
        if tile is None:
            return
        where, folder = opened(self.path)
        with where.open_input_file(f"{folder}/{tile.value}.i64") as f:
            ids = np.frombuffer(f.read(), "<i8")
        with where.open_input_file(f"{folder}/{tile.value}.f32") as f:
            data = np.frombuffer(f.read(), "<f4")
        if len(ids) != tile.rows or tile.rows and len(data) % tile.rows:
            raise ValueError(f"{tile.value} isn't a whole number of rows")
        data = data.reshape(tile.rows, -1)
        keep = (ids >= self.low) & (ids <= self.high)
        ids, data = ids[keep], data[keep]
        ends = np.arange(len(ids) + 1, dtype=np.int32) * (data.shape[1] if len(ids) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(data.ravel()))], names=["i", "row"])


class Names(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceArrowWriter):
    """Every attempt of a task writes files of its own names; those of attempts that aren't committed are deleted at the end."""

    def __init__(self, path: str, overwrite: bool, rows: int):
        self.path, self.rows = path, rows
        where, folder = opened(path)
        if overwrite and where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir_contents(folder)
        where.create_dir(folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Names:
        where, folder = opened(self.path)
        names, ids, data, held = [], [], [], 0

        def put() -> None:
            nonlocal held
            i, x = np.concatenate(ids), np.concatenate(data)
            while len(i) >= self.rows or len(i) and not held:
                own, x1 = i[: self.rows], x[: self.rows]
                name = f"tile-{len(own)}-{own.min()}-{own.max()}-{uuid.uuid4().hex}"
                for suffix, a in ((".i64", own.astype("<i8")), (".f32", x1.astype("<f4"))):
                    with where.open_output_stream(f"{folder}/{name}{suffix}") as f:
                        f.write(a.tobytes())
                names.append(name)
                i, x = i[self.rows :], x[self.rows :]
            ids[:], data[:], held = [i], [x], len(i)

        for b in batches:
            if b.num_rows:
                ids.append(b.column("i").to_numpy(zero_copy_only=False))
                data.append(b.column("row").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                held += b.num_rows
                if held >= self.rows:
                    put()
        if held:
            held = 0
            put()
        return Names(names)

    def commit(self, messages: list[Names | None]) -> None:
        where, folder = opened(self.path)
        kept = {n for m in messages if m for n in m.names}
        with where.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}") as f:
            f.write("\n".join(sorted(kept)).encode())
        known = set(kept)
        for info in where.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith("_committed-"):
                with where.open_input_file(info.path) as f:
                    known |= set(f.read().decode().split())
        for info in where.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith("tile-") and info.base_name.rsplit(".", 1)[0] not in known:
                where.delete_file(info.path)

    def abort(self, messages: list[Names | None]) -> None:
        where, folder = opened(self.path)
        for n in (n for m in messages if m for n in m.names):
            for suffix in (".i64", ".f32"):
                where.delete_file(f"{folder}/{n}{suffix}")


class RowTiles(DataSource):
    """Format `rowtiles` (i, row); options: path, rows (of a tile, when written)."""

    @classmethod
    def name(cls) -> str:
        return "rowtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("rows", ROWS)))


def registered(spark: SparkSession) -> SparkSession:
    importable(spark)
    spark.dataSource.register(RowTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_tiles(rows: DataFrame, path: str, size: int = ROWS) -> None:
    """Rows (i, row) as tiles of up to `size` rows, near numbers in one tile. All rows are of one length; none is null."""
    registered(rows.sparkSession)
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(F.col("i").cast("long").alias("i"), F.col("row").cast("array<float>").alias("row")).repartitionByRange(n, "i").sortWithinPartitions("i")
    dealt.write.format("rowtiles").option("rows", size).mode("append").save(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).read.format("rowtiles").load(path)
