"""ZIP archives as a data source: a partition for each entry, found in the archive's directory, so that entries are read by tasks of their own.

    spark.dataSource.register(ZipSource)
    spark.read.format("zipentries").option("paths", json.dumps([...])).load().where("entry = 'INFOTABLE.tsv'")

Paths are those of any file system that pyarrow opens (file, hdfs, s3, gs). Filters on archive and entry are pushed down: entries that they leave out
become no partition. A path is tried `attempts` times, and then under each of `origins` in its place (folders with copies); an archive that is nowhere gives a row of nulls besides its path.
"""

from __future__ import annotations

import json
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "archive string, entry string, n bigint, line string"
ARROW = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("n", pa.int64()), ("line", pa.string())])
CHUNK = 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Entry(InputPartition):
    archive: str
    place: str | None
    name: str | None


def _opened(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.origins, self.attempts, self.encoding = json.loads(options.get("origins", "[]")), int(options.get("attempts", 3)), options.get("encoding", "ISO-8859-1")
        self.wait = float(options.get("wait", 1.0))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("archive",), ("entry",)):
                self.tests.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def _wanted(self, **row: str | None) -> bool:
        said = {"EqualTo": lambda x, v: x == v, "In": lambda x, v: x in v, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith}
        return all(row[c] is not None and said[kind](row[c], v) for kind, c, v in self.tests if c in row)

    def _places(self, path: str) -> list[str]:
        return [path, *(f"{o.rstrip('/')}/{path.rsplit('/', 1)[-1]}" for o in self.origins)]

    def partitions(self) -> list[Entry]:
        out = []
        for path in self.paths:
            if not self._wanted(archive=path):
                continue
            found = self._directory(path)
            if found is None:
                out += [Entry(path, None, None)] * self._wanted(archive=path, entry=None)
            else:
                out += [Entry(path, found[0], name) for name in found[1] if self._wanted(archive=path, entry=name)]
        return out

    def _directory(self, path: str) -> tuple[str, list[str]] | None:
        """Where an archive is, and its entries; None if it is nowhere. Only the directory at its end is read."""
        for place in self._places(path):
            for attempt in range(self.attempts):
                try:
                    with _opened(place) as f, zipfile.ZipFile(f) as archive:
                        return place, [i.filename for i in archive.infolist() if not i.is_dir()]
                except FileNotFoundError:
                    break  # waiting won't bring it
                except (OSError, ValueError, zipfile.BadZipFile):  # pyarrow says ValueError of places before a file's beginning
                    time.sleep(self.wait * attempt)
        if all(self._missing(p) for p in self._places(path)):
            return None
        raise OSError(f"{path} can't be read, nor any copy of it")

    @staticmethod
    def _missing(place: str) -> bool:
        try:
            _opened(place).close()
        except FileNotFoundError:
            return True
        except (OSError, ValueError):
            pass
        return False

    def read(self, partition: Entry) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            yield pa.RecordBatch.from_pydict({"archive": [partition.archive], "entry": [None], "n": [None], "line": [None]}, schema=ARROW)
            return
        n, rest = 0, b""
        with _opened(partition.place) as f, zipfile.ZipFile(f) as archive, archive.open(partition.name) as entry:
            while True:
                piece = entry.read(CHUNK)
                lines = (rest + piece).split(b"\n")
                rest = lines.pop() if piece else b""
                if not piece and lines == [b""]:
                    return
                told = [x.removesuffix(b"\r").decode(self.encoding) for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([partition.archive] * len(told)), pa.array([partition.name] * len(told)), pa.array(range(n + 1, n + len(told) + 1)), pa.array(told, pa.string())], schema=ARROW)
                n += len(told)
                if not piece:
                    return


class ZipSource(DataSource):
    """archive, entry, n (from 1) and line of the entries of ZIP archives. Options: paths and origins (JSON lists), attempts, wait (seconds), encoding."""

    @classmethod
    def name(cls) -> str:
        return "zipentries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def entries(spark: SparkSession, paths: list[str], origins: list[str] = (), **options: str):
    """Lines of all entries of archives, as a DataFrame; filters on archive and entry prune its partitions."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ZipSource)
    return spark.read.format("zipentries").options(paths=json.dumps(list(paths)), origins=json.dumps(list(origins)), **options).load()
