"""Folders of raw signals, one file each, as a data source of Spark's: `spark.read.format("signals").load(folder)`."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowforge.functions import arrays as A

#: Bytes of files that a task reads, about.
BYTES = 64 << 20
#: Signals of one batch that a task passes on, by bytes.
BATCH = 8 << 20
KINDS = {"f4": np.dtype("<f4"), "f8": np.dtype("<f8")}


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI that driver and executors reach alike; a plain path is a local or mounted one."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Files(InputPartition):
    """Files of one task: (path, bytes)."""

    files: list[tuple[str, int]]


class SignalReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.suffix = options.get("suffix", ".f4")
        self.kind = KINDS[options.get("kind", "f4")]
        self.bytes = int(options.get("bytespertask", BYTES))

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, in runs of about `bytesPerTask`; sizes are listed, contents aren't read."""
        system, path = resolve(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")))
        out: list[list[tuple[str, int]]] = []
        room = 0
        for f in files:
            if not out or room < f[1]:
                out.append([])
                room = self.bytes
            out[-1].append(f)
            room -= f[1]
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = resolve(self.folder)
        held: list[tuple[str, int, np.ndarray]] = []
        for path, _ in partition.files:
            with system.open_input_stream(path) as f:
                data = f.read()
            if len(data) % self.kind.itemsize:
                raise ValueError(f"{path} has {len(data)} bytes, which isn't a whole number of values")
            held.append((path.removeprefix(root).lstrip("/"), len(data), np.frombuffer(data, self.kind).astype("<f8")))
            if sum(n for _, n, _ in held) >= BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        paths, sizes, signals = zip(*held, strict=True)
        ends = np.cumsum([0, *map(len, signals)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(signals))], ["path", "length", "signal"]
        )


class SignalFolder(DataSource):
    """Options: path; suffix (.f4); kind (f4 or f8, little-endian); bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "signals"

    def schema(self) -> str:
        return "path string, length bigint, signal array<double>"

    def reader(self, schema: object) -> SignalReader:
        return SignalReader({k.lower(): v for k, v in self.options.items()})


def read_signals(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, length, signal) of every file: its path below the folder, its bytes and its values."""
    spark.dataSource.register(SignalFolder)
    return spark.read.format("signals").options(**options).load(folder)


def write_signals(signals: DataFrame, folder: str, *, kind: str = "f4") -> int:
    """Each row (path, signal) to its own file; how many. A task that runs again writes its files again. Folders are made as they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = resolve(folder.rstrip("/"))
        made: set[str] = set()
        for b in batches:
            for path, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                to = f"{root}/{path}"
                above = to.rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(to) as f:
                    f.write(x.values.to_numpy(zero_copy_only=False).astype(KINDS[kind]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    done = signals.select("path", F.col("signal").cast("array<double>").alias("signal")).mapInArrow(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fitted(signal: str, *, left: int, length: int, gain: float) -> Column:
    """A signal as a model takes it: zeros in front, cut or filled to a length, scaled, and one channel doubled to two."""
    return A.stereo(F.transform(A.padded(signal, left, length), lambda x: x * gain))
