"""A streaming source over a dump of replication frames.

The dump is a directory of Parquet files (data_start, wal_end, payload) named in order of arrival.
Offsets are positions of commits: a batch never ends inside a transaction, and what was read is
confirmed (``commit``) only after the sink has it. An offset names the file and row that follow the
commit and the relations described so far, so a batch is read from there, and work follows the new
frames. One server's log is one ordered stream, so a batch is read by one task; everything after it
is parallel.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import takewhile

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .wire import Decoder, Relation, records

_ORDER = ["source", "source_system_id", "ingested_at", "lsn", "lsn_numeric", "xid", "commit_time", "action", "schema_name", "table_name", "key", "before", "after", "unchanged_toast_columns", "truncate_cascade", "truncate_restart_identity"]


def read_frames(path: str, file: str = "", row: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """All frames of a dump in order of arrival, from a row of a file on."""
    for _, _, frame in positioned(path, file, row):
        yield frame


def positioned(path: str, file: str = "", row: int = 0) -> Iterator[tuple[str, int, tuple[int, int, bytes]]]:
    """(file, row, frame) from a row of a file on; files and row groups before it are not read."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    for info in sorted((f for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet") and f.base_name >= file), key=lambda f: f.path):
        first = row if info.base_name == file else 0
        with system.open_input_file(info.path) as f:
            parquet, at = pq.ParquetFile(f), 0
            for group in range(parquet.num_row_groups):
                size = parquet.metadata.row_group(group).num_rows
                if at + size > first:
                    for batch in parquet.iter_batches(row_groups=[group], columns=["data_start", "wal_end", "payload"]):
                        for k, r in enumerate(batch.to_pylist()):
                            if at + k >= first:
                                yield info.base_name, at + k, (r["data_start"], r["wal_end"], r["payload"])
                        at += batch.num_rows
                else:
                    at += size


def peek(path: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, bytes]]:
    """Frames of the transactions confirmed after ``start`` and up to ``end``; nothing is consumed."""
    out, held = [], []
    for frame in read_frames(path):
        if frame[2][:1] == b"R":
            out.append(frame)
            continue
        held.append(frame)
        if frame[2][:1] == b"C":
            if frame[1] > start and (end is None or frame[1] <= end):
                out += held
            held = []
    return out


def _packed(relations: dict[int, Relation]) -> str:
    return json.dumps([[r.oid, r.schema, r.table, r.identity, r.columns] for r in relations.values()])


def _unpacked(text: str) -> dict[int, Relation]:
    return {oid: Relation(oid, schema, table, identity, tuple((n, k, bool(key)) for n, k, key in columns)) for oid, schema, table, identity, columns in json.loads(text)}


class Slice(InputPartition):
    def __init__(self, start: dict, end: dict):
        self.start, self.end = start, end


class FrameReader(DataSourceStreamReader):
    """Options: path; maxRecordsPerBatch and maxSecondsPerBatch, at which a batch ends with the next
    commit; resume, the offset at which a restarted query stands (see ingest); source, systemId,
    ingestedAt, contracts."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}  # Spark lowers the names of options
        self.path = self.options["path"]
        self.per_batch = int(self.options.get("maxrecordsperbatch", 500))
        self.seconds = float(self.options.get("maxsecondsperbatch", 60))
        self.at = json.loads(self.options["resume"]) if self.options.get("resume") else self.initialOffset()
        self.confirmed, self.frames_read = 0, 0

    def initialOffset(self) -> dict:
        return {"lsn": 0, "file": "", "row": 0, "relations": "[]"}

    def latestOffset(self) -> dict:
        """The commit at which the batch ends that follows the last one; never inside a transaction."""
        n, opened, decoder = 0, time.monotonic(), Decoder(_unpacked(self.at["relations"]))
        for file, row, (_, end, payload) in positioned(self.path, self.at["file"], self.at["row"]):
            self.frames_read += 1
            kind = payload[:1]
            if kind == b"R":
                decoder.decode(payload)
            elif kind in b"IUDT":
                n += 1
            elif kind == b"C":
                self.at = {"lsn": end, "file": file, "row": row + 1, "relations": _packed(decoder.relations)}
                if n >= self.per_batch or time.monotonic() - opened >= self.seconds:
                    break
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["lsn"] > self.at["lsn"]:
            self.at = end
        return [Slice(start, end)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        from ..operators.contracts import ContractError, contract_for, relation_violations

        def refuse(relation: Relation, lsn: str) -> None:
            problems = relation_violations(contract_for(relation.schema, relation.table), relation.table, list(relation.columns), lsn)
            if problems:
                raise ContractError("; ".join(problems))

        now = datetime.fromisoformat(self.options["ingestedat"]) if "ingestedat" in self.options else datetime.now(timezone.utc)
        if not self.options.get("systemid"):
            raise ContractError("systemId is required: positions compare within one instance only")
        check = refuse if self.options.get("contracts", "on") == "on" else None
        start, end = partition.start, partition.end
        stop = (end["file"], end["row"])
        frames = (frame for _, _, frame in takewhile(lambda x: x[:2] < stop, positioned(self.path, start["file"], start["row"])))
        if end["lsn"] <= start["lsn"]:
            return
        for _, r in records(frames, Decoder(_unpacked(start["relations"])), self.options.get("source", "postgres"), self.options["systemid"], now, check):
            yield tuple(r[c] for c in _ORDER)

    def commit(self, end: dict) -> None:
        self.confirmed = end["lsn"]


class FrameDump(DataSource):
    """``spark.readStream.format("frame_dump").load(path)`` gives the change log's columns."""

    @classmethod
    def name(cls) -> str:
        return "frame_dump"

    def schema(self) -> str | StructType:
        from .tables import CHANGE_LOG

        return CHANGE_LOG

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameReader(dict(self.options))


__all__ = ["FrameDump", "FrameReader", "peek", "positioned", "read_frames"]
