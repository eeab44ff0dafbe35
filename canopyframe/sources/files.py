"""File access shared by the Python data sources; any file system pyarrow knows will do."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

#: Bytes one read task covers.
SPLIT_BYTES = 64 * 1024 * 1024
#: Rows per Arrow batch.
BATCH_ROWS = 65_536
#: Folder of the commits inside an output folder.
COMMITS = "_commits"


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def open_read(path: str):
    system, inner = resolve(path)
    return system.open_input_file(inner)


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files of a path: the file itself, the committed parts of a folder, or all matching files below it."""
    system, inner = resolve(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    commits = _commits(system, inner)
    if commits is not None:
        infos = system.get_file_info([f"{inner}/{p['file']}" for p in _live(commits)])
    else:
        infos = system.get_file_info(fs.FileSelector(inner, recursive=True))
    found = [(prefix + i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(suffixes)]
    if not found:
        raise FileNotFoundError(f"no {'/'.join(suffixes)} file under {path}")
    return sorted(found)


def _commits(system: fs.FileSystem, inner: str) -> list[tuple[str, dict]] | None:
    """Commits of a folder in their order, None if it has no log."""
    if system.get_file_info(f"{inner}/{COMMITS}").type != fs.FileType.Directory:
        return None
    found = []
    for info in system.get_file_info(fs.FileSelector(f"{inner}/{COMMITS}")):
        if info.base_name.endswith(".json"):
            with system.open_input_file(info.path) as f:
                found.append((info.base_name, json.loads(f.read())))
    return sorted(found, key=lambda c: c[0])


def _live(commits: list[tuple[str, dict]]) -> list[dict]:
    """Parts from the last overwrite on."""
    first = max((i for i, (_, doc) in enumerate(commits) if doc["overwrite"]), default=0)
    return [p for _, doc in commits[first:] for p in doc["parts"]]


def folder_facts(path: str) -> dict:
    """What a written folder holds: ``parts``, ``count`` and, where the format knows it, the bounding box."""
    system, inner = resolve(path)
    parts = _live(_commits(system, inner) or [])
    return {"parts": parts, "count": sum(p["count"] for p in parts), **merge_boxes(parts)}


def tile_name(path: str) -> str:
    """Tile id of a file: its name without extension."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class RowRange(InputPartition):
    """Rows ``start`` (inclusive) to ``stop`` (exclusive) of one file."""

    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop

    def steps(self):
        for lo in range(self.start, self.stop, BATCH_ROWS):
            yield lo, min(lo + BATCH_ROWS, self.stop)


def row_ranges(path: str, rows: int, record_bytes: int) -> list[RowRange]:
    step = max(1, SPLIT_BYTES // max(record_bytes, 1))
    return [RowRange(path, lo, min(lo + step, rows)) for lo in range(0, rows, step)]


@dataclass
class PartMessage(WriterCommitMessage):
    part: dict | None = None


class PartWriter(DataSourceArrowWriter):
    """Writes one file per task; readers see the parts of the folder's commits.

    Subclasses turn batches into a header and body. File names are unique per
    attempt, so retried or speculative tasks leave no duplicates behind.
    """

    suffix = ".bin"

    def __init__(self, options: dict):
        self.options = dict(options)
        self.overwrite = bool(self.options.pop("overwrite", False))
        self.folder = options["path"].rstrip("/")

    def encode(self, batches, spool) -> tuple[bytes, list, dict]:
        """Fill spooled blocks; return header bytes, the blocks in order and the part's facts."""
        raise NotImplementedError

    def write(self, iterator):
        blocks: list = []

        def spool():
            f = tempfile.SpooledTemporaryFile(max_size=32 * 1024 * 1024)
            blocks.append(f)
            return f

        header, ordered, facts = self.encode(iterator, spool)
        if not facts["count"]:
            return PartMessage(None)
        system, inner = resolve(self.folder)
        system.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        with system.open_output_stream(f"{inner}/{name}") as out:
            out.write(header)
            for block in ordered:
                block.seek(0)
                while chunk := block.read(1 << 20):
                    out.write(chunk)
        return PartMessage({"file": name, **facts})

    def commit(self, messages):
        """Add a commit of this job's parts; no earlier file is changed, so writers at the same time lose nothing.

        Commits are ordered by time. An overwrite hides those before it and then deletes
        their parts; one that comes later, even by a job that began earlier, stays.
        """
        system, inner = resolve(self.folder)
        system.create_dir(f"{inner}/{COMMITS}", recursive=True)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        doc = {"overwrite": self.overwrite, "parts": [m.part for m in messages if m is not None and m.part is not None]}
        with system.open_output_stream(f"{inner}/{COMMITS}/{name}.tmp") as out:
            out.write(json.dumps(doc).encode())
        system.move(f"{inner}/{COMMITS}/{name}.tmp", f"{inner}/{COMMITS}/{name}.json")  # readers see a whole commit or none
        if self.overwrite:
            for other, old in _commits(system, inner) or []:
                if other < f"{name}.json":
                    for part in old["parts"]:
                        _delete(system, f"{inner}/{part['file']}")
                    _delete(system, f"{inner}/{COMMITS}/{other}")

    def abort(self, messages):
        system, inner = resolve(self.folder)
        for m in messages:
            if m is not None and m.part is not None:
                system.delete_file(f"{inner}/{m.part['file']}")


def _delete(system: fs.FileSystem, path: str) -> None:
    """Delete a file that another overwrite may have deleted already."""
    try:
        system.delete_file(path)
    except FileNotFoundError:
        pass


def box(columns: dict) -> dict:
    """Bounding box facts of numpy columns x, y, z."""
    return {"bbox_min": [float(columns[a].min()) for a in "xyz"], "bbox_max": [float(columns[a].max()) for a in "xyz"]}


def merge_boxes(parts: list[dict]) -> dict:
    boxes = [p for p in parts if "bbox_min" in p]
    if not boxes:
        return {}
    return {"bbox_min": [min(p["bbox_min"][k] for p in boxes) for k in range(3)],
            "bbox_max": [max(p["bbox_max"][k] for p in boxes) for k in range(3)]}


def to_numpy(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
