"""The commit log: one JSON file per record, published whole under the next number.

Readers take the names of data files from records alone, never from listing
folders: what was not published does not exist, whatever a crash left behind.
A checkpoint holds what all records up to its number add up to, so that opening
a log reads the latest checkpoint and the records after it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..errors import EngineError, FencedError
from .files import Files

LOG, EPOCHS, CHECKPOINTS = "_log", "_epoch", "_checkpoint"
#: Streaming readers' schema of a record.
RECORD_SCHEMA = "lsn long, type string, txn long, epoch long, body string"


@dataclass(frozen=True)
class Record:
    """``body``: what the record publishes, by kind; see ``store``."""

    lsn: int
    type: str
    txn: int
    epoch: int
    body: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"lsn": self.lsn, "type": self.type, "txn": self.txn, "epoch": self.epoch, "body": json.dumps(self.body)})

    @classmethod
    def from_json(cls, text: str) -> Record:
        raw = json.loads(text)
        return cls(raw["lsn"], raw["type"], raw["txn"], raw["epoch"], json.loads(raw["body"]))


class CommitLog:
    """The records after the latest checkpoint, up to number ``upto`` if one is given."""

    def __init__(self, files: Files, upto: int | None = None) -> None:
        self.files, self.upto = files, upto
        for folder in (LOG, EPOCHS, CHECKPOINTS):
            files.make(folder)
        self.records: list[Record] = []
        self.epoch = 0
        self.base, self._txn, self.checkpoint = self._latest_checkpoint()
        self.refresh()

    def _latest_checkpoint(self) -> tuple[int, int, dict | None]:
        for name in reversed([n for n in self.files.names(CHECKPOINTS) if n.endswith(".json")]):
            if self.upto is None or int(name[:-5]) <= self.upto:
                raw = json.loads(self.files.read(f"{CHECKPOINTS}/{name}"))
                return raw["lsn"], raw["txn"], raw["state"]
        return 0, 0, None

    @property
    def lsn(self) -> int:
        return self.base + len(self.records)

    def _later(self) -> list[str]:
        return [n for n in self.files.names(LOG) if n.endswith(".json") and int(n[:-5]) > self.lsn]

    def refresh(self) -> list[Record]:
        """Read the records published since; what cannot be read ends the log, as if it were not published."""
        known = len(self.records)
        for name in self._later():
            if self.upto is not None and self.lsn >= self.upto:
                break
            try:
                record = Record.from_json(self.files.read(f"{LOG}/{name}"))
            except (ValueError, KeyError, TypeError):
                break
            if record.lsn != self.lsn + 1:
                break
            self.records.append(record)
        return self.records[known:]

    @property
    def next_txn(self) -> int:
        return max([self._txn, *(r.txn for r in self.records)]) + 1

    @property
    def newest_epoch(self) -> int:
        return max((int(n) for n in self.files.names(EPOCHS) if n.isdigit()), default=0)

    def take_over(self, least: int = 0) -> int:
        """Become the writer: claim the next epoch, or number ``least`` if that is later, which fences all earlier writers.

        A torn last record is set aside, so that its number can be used again.
        """
        if self.upto is not None:
            raise EngineError("a past state cannot be written to")
        while True:
            next_ = max(self.newest_epoch + 1, least)
            if self.files.create(f"{EPOCHS}/{next_}"):
                self.epoch = next_
                break
        self.refresh()
        if torn := self._later():
            if len(torn) > 1:
                raise EngineError(f"the log is damaged at {torn[0]}, before its end")
            self.files.set_aside(f"{LOG}/{torn[0]}", f".torn-{self.epoch}")
        return self.epoch

    def append(self, kind: str, txn: int, body: dict | None = None) -> Record:
        if not self.epoch:
            raise EngineError("this engine is read-only")
        if self.newest_epoch > self.epoch:
            raise FencedError(f"epoch {self.epoch} has ended")
        record = Record(self.lsn + 1, kind, txn, self.epoch, body or {})
        if not self.files.publish(f"{LOG}/{record.lsn:020d}.json", record.to_json()):
            raise FencedError(f"record {record.lsn} was written by another engine")
        self.records.append(record)
        return record

    def write_checkpoint(self, state: dict) -> None:
        """Keep what all records so far add up to."""
        text = json.dumps({"lsn": self.lsn, "txn": self.next_txn - 1, "state": state})
        self.files.publish(f"{CHECKPOINTS}/{self.lsn:020d}.json", text)
