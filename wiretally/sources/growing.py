"""A streaming source that reads logs on while they are being written.

A stream's offset is the length up to which each log was read. A log rarely
ends with a whole record, and where the next record begins only the task knows
that has read what came before. Each task therefore leaves a small note in a
shared folder: the byte and the number of the first record it did not read.
The task that goes on from that length starts there; a record that is cut waits
until the rest of it is there. A note depends on the log's bytes alone, so a
task that runs twice writes the same one, and a restarted query finds it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wiretally.sources.captures import FILE_STEM, FOLDER_ID, SEGMENT_NAME, raw_schema, rows_of
from wiretally.sources.files import resolve

#: Bytes of one log that one micro-batch reads at most; a task holds so many.
BYTES_PER_TRIGGER = 128 << 20

_ID_TYPES = {"int": (T.IntegerType(), pa.int32()), "bigint": (T.LongType(), pa.int64()), "string": (T.StringType(), pa.string())}


@dataclass
class Stretch(InputPartition):
    """What to read of one log: from where the read up to ``start`` ended, up to ``stop``."""

    path: str
    start: int
    stop: int


class Notes:
    """Where reads ended, below a folder that driver and executors share."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _place(self, path: str) -> tuple[fs.FileSystem, str]:
        store, root = resolve(self.root)
        return store, f"{root}/{hashlib.sha256(path.encode()).hexdigest()}"

    def get(self, path: str, upto: int) -> dict:
        store, folder = self._place(path)
        with store.open_input_stream(f"{folder}/{upto}.json") as note:
            return json.loads(note.read())

    def put(self, path: str, upto: int, note: dict) -> None:
        store, folder = self._place(path)
        store.create_dir(folder)
        staged = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as out:
            out.write(json.dumps(note).encode())
        store.move(staged, f"{folder}/{upto}.json")

    def lengths(self, path: str) -> list[int]:
        store, folder = self._place(path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def forget_before(self, path: str, upto: int) -> None:
        """Drops notes that no batch can start from: all before the last one before ``upto``."""
        store, folder = self._place(path)
        earlier = [n for n in self.lengths(path) if n < upto]
        for n in earlier[:-1]:
            store.delete_file(f"{folder}/{n}.json")


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.notes = Notes(options["progress"])
        self.id_type = options["captureIdType"]
        self.most = int(options["bytesPerTrigger"])
        self.read_upto: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Lengths of all logs, each at most a trigger's bytes beyond what was read."""
        store, root = resolve(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        lengths = {}
        for f in found:
            if f.type != fs.FileType.File or f.base_name[0] in "._" or not f.size:
                continue
            name = f.path.removeprefix(root).lstrip("/")
            if name not in self.read_upto:
                self.read_upto[name] = max(self.notes.lengths(name), default=0)
            lengths[name] = min(f.size, self.read_upto[name] + self.most)
        return lengths

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.read_upto.update(end)
        return [Stretch(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def commit(self, end: dict) -> None:
        for path, upto in end.items():
            self.notes.forget_before(path, upto)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        named = re.search(SEGMENT_NAME, partition.path)
        segment = int(named[1]) if named else 0
        folder = re.search(FOLDER_ID, f"/{partition.path}")
        text = folder[1] if folder else re.search(FILE_STEM, partition.path)[1]
        capture_id = pa.scalar(text).cast(_ID_TYPES[self.id_type][1])
        note = self.notes.get(partition.path, partition.start) if partition.start else {"byte": 0, "record": segment}
        if "problem" not in note:
            store, root = resolve(self.path)
            with store.open_input_file(f"{root}/{partition.path}") as log:
                log.seek(note["byte"])
                data = log.read(partition.stop - note["byte"])
            base, record, end = note["byte"], note["record"], partition.stop
            note = {}
            for batch in rows_of(memoryview(data), 0, len(data), capture_id, pa.scalar(segment), record, False, base):
                problem = batch.column("error")[0].as_py()
                if problem:
                    end = int(problem.rsplit(" ", 1)[1])
                    if problem.startswith("cut record"):
                        continue
                    note["problem"] = problem
                else:
                    record += len(batch)
                yield batch
            note |= {"byte": end, "record": record}
        self.notes.put(partition.path, partition.stop, note)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing-captures"

    def schema(self) -> T.StructType:
        capture_id = T.StructField("capture_id", _ID_TYPES[self.options["captureIdType"]][0])
        return raw_schema(capture_id, False)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        names = ("path", "progress", "captureIdType", "bytesPerTrigger")  # whose case options forget
        return GrowingLogReader({n: self.options[n] for n in names})


def stream_growing_captures(
    spark: SparkSession,
    path: str,
    progress: str,
    capture_id_type: str = "string",
    bytes_per_trigger: int = BYTES_PER_TRIGGER,
) -> DataFrame:
    """A stream of ``packets_raw`` of all logs below ``path``, also of those still written to.

    Each record comes once, as soon as it is whole, whatever lengths the logs
    are seen at and however often the query restarts. Logs of any size are read
    ``bytes_per_trigger`` at a time, each by one task. A damaged record ends its
    log with an error row. ``capture_id_type`` is int, bigint or string.

    ``progress`` is a folder that driver and executors share and that belongs
    to this query, like its checkpoint. The offset has an entry per log: move
    logs away that will not grow any more if there are hundreds of thousands.
    """
    if capture_id_type not in _ID_TYPES:
        raise ValueError(f"capture_id_type must be one of {', '.join(_ID_TYPES)}")
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format(GrowingLogs.name())
    options = {"path": path, "progress": progress, "captureIdType": capture_id_type, "bytesPerTrigger": bytes_per_trigger}
    return reader.options(**options).load()
