"""Frames of the logical replication protocol: decoding, encoding for fixtures, and change records.

The format (fixed values): big-endian numbers, strings that end in NUL. Frames begin with a letter:
B begin, C commit, R relation, I insert, U update, D delete, T truncate.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

WIRE_EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)


class WireError(ValueError):
    """Bytes that are no frame."""


class Cursor:
    """Reads values off a frame, never past its end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise WireError(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(">" + code, self.take(struct.calcsize(">" + code)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise WireError("a string without an end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


@dataclass(frozen=True)
class Relation:
    oid: int
    schema: str
    table: str
    identity: str
    columns: tuple[tuple[str, int, bool], ...]  # name, type number, key flag


@dataclass(frozen=True)
class Begin:
    final_lsn: int
    commit_time: datetime
    xid: int


@dataclass(frozen=True)
class Commit:
    commit_lsn: int
    end_lsn: int
    commit_time: datetime


@dataclass(frozen=True)
class RowChange:
    action: str
    relation: Relation
    before: dict | None
    after: dict | None
    unchanged: tuple[str, ...] = ()


@dataclass(frozen=True)
class Truncation:
    relations: tuple[Relation, ...]
    cascade: bool
    restart_identity: bool


def _time(us: int) -> datetime:
    return WIRE_EPOCH + timedelta(microseconds=us)


@dataclass
class Decoder:
    """Decodes frames in the order of their arrival; it remembers relations, as later frames name them by number."""

    relations: dict[int, Relation] = field(default_factory=dict)

    def decode(self, frame: bytes):
        c = Cursor(frame)
        kind = c.take(1)
        if kind == b"B":
            return Begin(c.number("q"), _time(c.number("q")), c.number("I"))
        if kind == b"C":
            flags = c.number("B")
            if flags:
                raise WireError(f"unknown flags {flags} of a commit")
            return Commit(c.number("q"), c.number("q"), _time(c.number("q")))
        if kind == b"R":
            oid, schema, table, identity, n = c.number("I"), c.text(), c.text(), c.take(1).decode(), c.number("h")
            columns = []
            for _ in range(n):
                flags, name, kind_oid = c.number("B"), c.text(), c.number("I")
                c.number("i")
                columns.append((name, kind_oid, bool(flags & 1)))
            self.relations[oid] = out = Relation(oid, schema, table, identity, tuple(columns))
            return out
        if kind == b"T":
            n, flags = c.number("i"), c.number("B")
            return Truncation(tuple(self._relation(c.number("I")) for _ in range(n)), bool(flags & 1), bool(flags & 2))
        if kind in b"IUD":
            relation = self._relation(c.number("I"))
            before = after = None
            unchanged: tuple[str, ...] = ()
            marker = c.take(1)
            if marker in (b"K", b"O"):
                if kind == b"I":
                    raise WireError("an insert with an old row")
                before, _ = self._row(c, relation)
                marker = c.take(1) if kind == b"U" else b""
            if kind in b"IU":
                if marker != b"N":
                    raise WireError(f"no new row but {marker!r}")
                after, unchanged = self._row(c, relation)
            elif before is None:
                raise WireError("a delete without an old row")
            return RowChange({b"I": "insert", b"U": "update", b"D": "delete"}[kind], relation, before, after, unchanged)
        raise WireError(f"unknown frame {kind!r}")

    def _relation(self, oid: int) -> Relation:
        if oid not in self.relations:
            raise WireError(f"relation {oid} was never described")
        return self.relations[oid]

    @staticmethod
    def _row(c: Cursor, relation: Relation) -> tuple[dict, tuple[str, ...]]:
        n = c.number("h")
        if n != len(relation.columns):
            raise WireError(f"{n} values for {len(relation.columns)} columns of {relation.table}")
        row, unchanged = {}, []
        for name, _, _ in relation.columns:
            kind = c.take(1)
            if kind == b"t":
                row[name] = c.take(c.number("i")).decode()
            elif kind == b"n":
                row[name] = None
            elif kind == b"u":
                unchanged.append(name)
            else:
                raise WireError(f"value of kind {kind!r}")
        return row, tuple(unchanged)


def lsn_text(n: int) -> str:
    return f"{n >> 32:X}/{n & 0xFFFFFFFF:X}"


def records(frames: Iterable[tuple[int, int, bytes]], decoder: Decoder, source: str, system_id: str, ingested_at: datetime, on_relation=None) -> Iterator[tuple[int, dict]]:
    """(end position of its transaction, change record) of (data_start, wal_end, frame) in order, whole transactions only.

    A change is identified by its own position (data_start), its transaction is confirmed by the
    commit's wal_end. ``on_relation`` (relation, position) may raise to refuse a schema.
    """
    begin, held = None, []
    for start, end, frame in frames:
        m = decoder.decode(frame)
        if isinstance(m, Begin):
            begin, held = m, []
        elif isinstance(m, Relation):
            if on_relation:
                on_relation(m, lsn_text(start))
        elif isinstance(m, Commit):
            yield from ((end, r) for r in held)
            begin, held = None, []
        else:
            if begin is None:
                raise WireError("a change outside a transaction")
            common = {"source": source, "source_system_id": system_id, "ingested_at": ingested_at, "lsn": lsn_text(start), "lsn_numeric": start, "xid": begin.xid, "commit_time": begin.commit_time}
            none = {"key": None, "before": None, "after": None, "unchanged_toast_columns": None, "truncate_cascade": None, "truncate_restart_identity": None}
            if isinstance(m, Truncation):
                held += [{**common, **none, "action": "truncate", "schema_name": r.schema, "table_name": r.table, "truncate_cascade": m.cascade, "truncate_restart_identity": m.restart_identity} for r in m.relations]
            else:
                row = m.after if m.after is not None else m.before
                missing = [n for n, _, is_key in m.relation.columns if is_key and n not in row]
                if missing:
                    raise WireError(f"no value of key {', '.join(missing)} of {m.relation.table} at {lsn_text(start)}")
                key = {n: row[n] for n, _, is_key in m.relation.columns if is_key}
                held.append({**common, **none, "action": m.action, "schema_name": m.relation.schema, "table_name": m.relation.table, "key": key, "before": m.before, "after": m.after, "unchanged_toast_columns": list(m.unchanged)})


class Writer:
    """Builds frames, for fixtures."""

    @staticmethod
    def begin(lsn: int, us: int, xid: int) -> bytes:
        return b"B" + struct.pack(">qqI", lsn, us, xid)

    @staticmethod
    def commit(lsn: int, end: int, us: int, flags: int = 0) -> bytes:
        return b"C" + struct.pack(">Bqqq", flags, lsn, end, us)

    @staticmethod
    def relation(oid: int, table: str, columns: list[tuple[str, int, bool]], schema: str = "public") -> bytes:
        body = b"".join(struct.pack(">B", key) + n.encode() + b"\0" + struct.pack(">Ii", kind, -1) for n, kind, key in columns)
        return b"R" + struct.pack(">I", oid) + schema.encode() + b"\0" + table.encode() + b"\0d" + struct.pack(">h", len(columns)) + body

    @staticmethod
    def row(values: list) -> bytes:
        """A value is text, None, or ... for an unchanged one."""
        out = struct.pack(">h", len(values))
        for v in values:
            out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v.encode())) + v.encode()
        return out

    @classmethod
    def insert(cls, oid: int, values: list) -> bytes:
        return b"I" + struct.pack(">I", oid) + b"N" + cls.row(values)

    @classmethod
    def update(cls, oid: int, values: list, old: list | None = None) -> bytes:
        return b"U" + struct.pack(">I", oid) + (b"K" + cls.row(old) if old else b"") + b"N" + cls.row(values)

    @classmethod
    def delete(cls, oid: int, old: list) -> bytes:
        return b"D" + struct.pack(">I", oid) + b"K" + cls.row(old)

    @staticmethod
    def truncate(oids: list[int], flags: int = 0) -> bytes:
        return b"T" + struct.pack(">iB", len(oids), flags) + struct.pack(f">{len(oids)}I", *oids)
