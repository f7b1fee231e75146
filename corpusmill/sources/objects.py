"""A store of contents by their SHA-256 as a data source: spark.read, df.write and spark.readStream with format "objects".

An object lies at <first two digits>/<digest>. Tasks write drafts, read them back, verify them and rename them, so an object
is whole or not there; each task lists what it has put in a manifest, by prefix. A commit is an entry of the log that
names the manifests: what no entry names is not read, so a write that is aborted shows nothing. Overwriting makes an
entry that hides those before it. Reading verifies each content and refuses one that does not have its digest; a filter
on the digest reads that object alone. A stream's offsets are the numbers of entries.

Defined results: null contents are left out, empty ones are objects; contents that are there already are verified and kept;
a digest that comes with a content must be its own. Equal objects are one, whichever entries name them; a stream
brings them once an entry.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "sha256 string, size long, content binary"
#: Digits of a digest that name a folder, and so a partition.
PREFIX = 2
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format known; filters reach it from then on."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ObjectSource)


def opened(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri) if "://" in uri else FileSystem.from_uri(f"file://{os.path.abspath(uri)}")


def names(fs: FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found)


def entries(fs: FileSystem, root: str) -> dict[int, dict]:
    out = {}
    for name in names(fs, f"{root}/log"):
        if name.isdigit():
            with fs.open_input_stream(f"{root}/log/{name}") as f:
                out[int(name)] = json.loads(f.read())
    return out


def add_entry(fs: FileSystem, root: str, entry: dict) -> int:
    """Under the next number that is free; made once, as far as the file system can tell."""
    fs.create_dir(f"{root}/log", recursive=True)
    number = max((int(n) for n in names(fs, f"{root}/log") if n.isdigit()), default=-1) + 1
    while True:
        path = f"{root}/log/{number:012d}"
        draft = f"{root}/log/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(entry).encode())
        if isinstance(fs, LocalFileSystem):
            try:
                os.link(draft, path)
                return number
            except FileExistsError:
                number += 1
            finally:
                fs.delete_file(draft)
        elif fs.get_file_info(path).type == FileType.NotFound:
            fs.move(draft, path)
            return number
        else:
            fs.delete_file(draft)
            number += 1


def verified(fs: FileSystem, path: str, digest: str) -> bytes:
    with fs.open_input_stream(path) as f:
        content = f.read()
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError(f"corrupt object {digest}")
    return content


def put(fs: FileSystem, root: str, content: bytes, expected: str | None = None) -> str:
    """Store a content, verified as it is read back. -> its digest."""
    digest = hashlib.sha256(content).hexdigest()
    if expected is not None and expected.lower() != digest:
        raise ValueError(f"the content has the digest {digest}, not {expected}")
    path = f"{root}/{digest[:PREFIX]}/{digest}"
    if fs.get_file_info(path).type == FileType.File:
        verified(fs, path, digest)
        return digest
    fs.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{root}/{digest[:PREFIX]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(content)
    try:
        verified(fs, draft, digest)
    except ValueError:
        fs.delete_file(draft)
        raise
    fs.move(draft, path)
    return digest


@dataclass
class Part(InputPartition):
    """Objects of a prefix that some manifests list; `only`: those digests alone."""

    prefix: str
    manifests: list[str]
    only: list[str] | None = None


@dataclass
class Written(WriterCommitMessage):
    manifest: str | None


def read_part(root_uri: str, part: Part) -> Iterator[tuple[str, int, bytes]]:
    fs, root = opened(root_uri)
    seen: set[str] = set()
    for manifest in part.manifests:
        path = f"{root}/manifests/{manifest}/{part.prefix}"
        if fs.get_file_info(path).type != FileType.File:
            continue
        with fs.open_input_stream(path) as f:
            listed = f.read().decode().split()
        for digest in listed:
            if digest not in seen and (part.only is None or digest in part.only):
                seen.add(digest)
                content = verified(fs, f"{root}/{digest[:PREFIX]}/{digest}", digest)
                yield digest, len(content), content


def parts_of(fs: FileSystem, root: str, told: list[dict], only: list[str] | None = None) -> list[Part]:
    live: list[str] = []
    for entry in told:
        live = list(entry["manifests"]) if entry["replaces"] else live + entry["manifests"]
    prefixes: dict[str, list[str]] = {}
    for manifest in live:
        for prefix in names(fs, f"{root}/manifests/{manifest}"):
            prefixes.setdefault(prefix, []).append(manifest)
    wanted = None if only is None else {d[:PREFIX] for d in only}
    return [Part(p, m, only) for p, m in sorted(prefixes.items()) if wanted is None or p in wanted]


class ObjectReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.only = uri, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("sha256",) and self.only is None:
                self.only = [f.value] if isinstance(f, EqualTo) else list(f.value)
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = opened(self.uri)
        told = entries(fs, root)
        return parts_of(fs, root, [told[n] for n in sorted(told)], self.only) or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return read_part(self.uri, partition)


class ObjectWriter(DataSourceWriter):
    def __init__(self, uri: str, columns: list[str], overwrite: bool):
        self.uri, self.columns, self.overwrite = uri, columns, overwrite

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(self.uri)
        content, sha = self.columns.index("content"), self.columns.index("sha256") if "sha256" in self.columns else None
        done: dict[str, list[str]] = {}
        for row in iterator:
            if row[content] is not None:
                digest = put(fs, root, bytes(row[content]), row[sha] if sha is not None else None)
                done.setdefault(digest[:PREFIX], []).append(digest)
        if not done:
            return Written(None)
        manifest = uuid.uuid4().hex
        fs.create_dir(f"{root}/manifests/{manifest}", recursive=True)
        for prefix, digests in done.items():
            with fs.open_output_stream(f"{root}/manifests/{manifest}/{prefix}") as f:
                f.write("\n".join(dict.fromkeys(digests)).encode())
        return Written(manifest)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.uri)
        add_entry(fs, root, {"manifests": [m.manifest for m in messages if m and m.manifest], "replaces": self.overwrite})

    def abort(self, messages: list[Written | None]) -> None:
        """Manifests go; objects that no entry names are not read, and may be another writer's."""
        fs, root = opened(self.uri)
        for m in messages:
            if m and m.manifest:
                fs.delete_dir(f"{root}/manifests/{m.manifest}")


class ObjectStream(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        fs, root = opened(self.uri)
        return {"entries": max(entries(fs, root), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        fs, root = opened(self.uri)
        told = entries(fs, root)
        new = [told[n] | {"replaces": False} for n in range(start["entries"], end["entries"])]
        return parts_of(fs, root, new) or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return read_part(self.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"], schema.names, overwrite)

    def streamReader(self, schema) -> ObjectStream:
        return ObjectStream(self.options["path"])
