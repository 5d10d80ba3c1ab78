"""Data sources of their own: pages of JSON records by split, Arrow folders by split, files made by tasks.

``register(spark)`` names them ``pages``, ``arrow_folder`` and ``made_files``.
Folders may lie in any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _listed(uri: str, deep: bool = False) -> list[fs.FileInfo]:
    store, path = opened(uri)
    return sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=deep)), key=lambda f: f.path)


# ---- pages of JSON records


@dataclass
class Page(InputPartition):
    split: str
    number: int
    place: str


class PagesReader(DataSourceReader):
    """A partition for each page of each split; only the splits that a filter asks for are listed."""

    def __init__(self, options: dict[str, str]):
        self.at, self.records = options["path"].rstrip("/"), options.get("records", "records")
        self.wanted = [s for s in options.get("splits", "").split(",") if s]
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("split",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = own if self.only is None else self.only & own
            else:
                yield f

    def _asked(self, place: str) -> dict:
        if urlsplit(place).scheme in ("http", "https"):
            from pairmill.sources.http import Client

            status, body, _ = Client(3, 0.2, 30.0, None).get(place)
            if body is None:
                raise OSError(f"{place}: {status}")
            return json.loads(body)
        store, path = opened(place)
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _pages(self, split: str) -> list[Page]:
        if urlsplit(self.at).scheme in ("http", "https"):  # the first page says how many there are
            url = urlsplit(self.at)
            place = lambda k: urlunsplit(url._replace(path=f"{url.path}/{split}", query=f"{url.query}&page={k}".lstrip("&")))
            return [Page(split, k, place(k)) for k in range(int(self._asked(place(0))["pages"]))]
        files = [f for f in _listed(f"{self.at}/{split}") if f.is_file and f.extension == "json"]
        return [Page(split, k, f"{self.at}/{split}/{f.base_name}") for k, f in enumerate(files)]

    def partitions(self):
        there = self.wanted or [f.base_name for f in _listed(self.at) if f.type == fs.FileType.Directory]
        found = {s: self._pages(s) for s in there if self.only is None or s in self.only}
        lacking = [s for s in self.wanted if s in found and not found[s]]
        if lacking:
            raise FileNotFoundError(f"{self.at} has no split {', '.join(lacking)}")
        return [p for pages in found.values() for p in pages] or [Page("", -1, "")]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        records = self._asked(partition.place)[self.records]
        n = len(records)
        yield pa.record_batch({"split": pa.array([partition.split] * n, pa.string()), "page": pa.array([partition.number] * n, pa.int32()), "record": pa.array([json.dumps(r, ensure_ascii=False) for r in records], pa.string())})


class PagesSource(DataSource):
    """split, page and record (JSON) of pages. Options: path (a folder ``split/*.json``, or a URL whose answers to ``/split?page=k`` have ``pages`` and records), splits (all that are there), records (the list's key)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "split string, page int, record string"

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(dict(self.options))


# ---- Arrow folders


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote: (split, name, rows) of files that lie in the job's temporary folder."""

    files: list = field(default_factory=list)


class _CommittedWriter(DataSourceArrowWriter):
    """Tasks write under ``_temporary``; commit moves the files of the attempts that count and abort leaves nothing."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.at, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def place(self, name: str) -> tuple[fs.FileSystem, str]:
        store, path = opened(f"{self.at}/_temporary/{self.job}/{name}")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store, path

    def _clean(self) -> None:
        store, path = opened(f"{self.at}/_temporary")
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)

    def commit(self, messages) -> None:
        store, path = opened(self.at)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in _listed(self.at):
                if old.base_name != "_temporary":
                    store.delete_dir(old.path) if old.type == fs.FileType.Directory else store.delete_file(old.path)
        for m in messages:
            for split, name, _ in m.files if m else []:
                folder = f"{path}/{split}" if split else path
                store.create_dir(folder, recursive=True)
                store.move(f"{path}/_temporary/{self.job}/{name}", f"{folder}/{name}")
        self._clean()
        self.committed(store, path, [f for m in messages if m for f in m.files])

    def committed(self, store: fs.FileSystem, path: str, files: list) -> None: ...

    def abort(self, messages) -> None:
        self._clean()


class ArrowFolderWriter(_CommittedWriter):
    """Arrow IPC files by split, and ``dataset_info.json`` with the number of rows of each split."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options, overwrite)
        self.split = options.get("splitcolumn", options.get("splitColumn", "split"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        open_: dict[str, list] = {}
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            kinds = table[self.split].unique().to_pylist() if self.split in table.column_names else [""]
            for kind in kinds:
                rows = table
                if self.split in table.column_names:
                    same = pa.compute.equal(table[self.split], kind) if kind is not None else pa.compute.is_null(table[self.split])
                    rows = table.filter(same).drop_columns([self.split])
                split = "none" if kind is None else str(kind)
                if split not in open_:
                    name = f"{split or 'data'}-{uuid.uuid4().hex}.arrow"
                    store, path = self.place(name)
                    sink = store.open_output_stream(path)
                    open_[split] = [name, sink, pa.ipc.new_file(sink, rows.schema), 0]
                open_[split][2].write_table(rows)
                open_[split][3] += rows.num_rows
        done = []
        for split, (name, sink, file, n) in open_.items():
            file.close()
            sink.close()
            done.append((split, name, n))
        return Written(done)

    def committed(self, store: fs.FileSystem, path: str, files: list) -> None:
        sizes: dict[str, int] = {}
        info = f"{path}/dataset_info.json"
        if not self.overwrite and store.get_file_info(info).is_file:
            with store.open_input_stream(info) as f:
                sizes = json.loads(f.read())["splits"]
        for split, _, n in files:
            sizes[split] = sizes.get(split, 0) + n
        with store.open_output_stream(info) as f:
            f.write(json.dumps({"splits": sizes}, sort_keys=True).encode())


@dataclass
class ArrowFile(InputPartition):
    split: str
    place: str


class ArrowFolderReader(DataSourceReader):
    """A partition for each file; batches come as they were written."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.at, self.names = options["path"].rstrip("/"), names
        self.split, self.only = options.get("splitcolumn", options.get("splitColumn", "split")), [s for s in options.get("splits", "").split(",") if s]

    def partitions(self):
        files = [f for f in _listed(self.at, deep=True) if f.extension == "arrow" and "/_temporary/" not in f.path]
        root = opened(self.at)[1]
        out = [ArrowFile((own := f.path[len(root) :].strip("/").split("/"))[0] if "/" in f.path[len(root) :].strip("/") else "", f"{self.at}/{'/'.join(own)}") for f in files]
        return [p for p in out if not self.only or p.split in self.only] or [ArrowFile("", "")]

    def read(self, partition: ArrowFile) -> Iterator[pa.RecordBatch]:
        if not partition.place:
            return
        store, path = opened(partition.place)
        with store.open_input_file(path) as source, pa.ipc.open_file(source) as file:
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                columns = {n: batch[n] for n in batch.schema.names} | {self.split: pa.array([partition.split] * batch.num_rows, pa.string())}
                yield pa.record_batch({n: columns[n] for n in self.names})


class ArrowFolder(DataSource):
    """A folder of Arrow files, a folder within for each value of splitColumn. Options: path, splitColumn (split), splits (all)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_folder"

    def reader(self, schema: StructType) -> ArrowFolderReader:
        return ArrowFolderReader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowFolderWriter:
        return ArrowFolderWriter(dict(self.options), overwrite)


# ---- files made by tasks


#: Files of a folder, or loose files, that a task reads.
FILES = 1_000


class FilesWriter(_CommittedWriter):
    """A file for each row (name, content); with filesPerFolder in folders of so many, each moved as a whole, so commit doesn't grow with the files."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options, overwrite)
        self.many = int(options.get("filesperfolder", options.get("filesPerFolder", "0")))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, folder, n = [], "", 0
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist()):
                if not self.many:
                    store, path = self.place(name)
                    done.append(("", name, 1))
                elif n % self.many == 0:
                    folder = uuid.uuid4().hex
                    store, path = self.place(f"{folder}/{name}")
                    done.append(("", folder, self.many))
                else:
                    path = f"{path.rsplit('/', 1)[0]}/{name}"
                with store.open_output_stream(path, compression=None) as f:
                    f.write(content or b"")
                n += 1
        return Written(done)


@dataclass
class Folder(InputPartition):
    place: str
    names: list = field(default_factory=list)


class FilesReader(DataSourceReader):
    """file and content: a partition for each folder, whose files the task itself lists, and for each FILES loose files."""

    def __init__(self, options: dict[str, str]):
        self.at = options["path"].rstrip("/")

    def partitions(self):
        found = [f for f in _listed(self.at) if not f.base_name.startswith(("_", "."))]
        loose = [f.base_name for f in found if f.is_file]
        out = [Folder(f"{self.at}/{f.base_name}") for f in found if not f.is_file]
        return out + [Folder(self.at, loose[k : k + FILES]) for k in range(0, len(loose), FILES)] or [Folder("")]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not partition.place:
            return
        store, path = opened(partition.place)
        names = partition.names or [f.base_name for f in _listed(partition.place) if f.is_file]
        for name in names:
            with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                yield (f"{partition.place}/{name}", f.read())


class MadeFiles(DataSource):
    """Rows (name string, content binary) as files of a folder, all of them or none; read as rows (file string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "made_files"

    def schema(self) -> str:
        return "file string, content binary"

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Name the sources; filters reach them, so only the splits that are asked for are listed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PagesSource, ArrowFolder, MadeFiles):
        spark.dataSource.register(source)
