"""Maildir folders and the small text files beside them; message bodies are not opened."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_DIGITS = re.compile(r"[0-9]*")
_BITS = {"S": 1, "R": 2, "F": 4, "T": 8, "D": 16, "P": 32}
_U32, _U64 = (1 << 32) - 1, (1 << 64) - 1


def letter_bits(letters: str) -> int:
    """The flags of letters in any order; unknown letters count for nothing."""
    return sum(_BITS[c] for c in set(letters) if c in _BITS)


def parse_name(name: str) -> tuple[int | None, int]:
    """uid and flags of a file name: the number after the first ,U= (none and 0 are absent) and the letters after the first :2,."""
    _, _, after = name.partition(",U=")
    digits = int(_DIGITS.match(after)[0] or "0")
    _, _, letters = name.partition(":2,")
    return (digits & _U32 if digits <= _U64 else _U32) or None, letter_bits(letters)


class _Part(InputPartition):
    def __init__(self, path: str, indir: int):
        self.path, self.indir = path, indir


class MaildirReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Part(os.path.join(self.path, d), k) for k, d in enumerate(("cur", "new"))]

    def read(self, part: _Part) -> Iterator[tuple]:
        with os.scandir(part.path) as entries:  # a folder that is missing is an error: as an empty one it would look as if all mail were deleted
            for e in entries:
                if not e.name.startswith("."):
                    yield *parse_name(e.name), e.name, part.indir


class Maildir(DataSource):
    """spark.read.format("maildir").load(path): uid, flags, name, indir (0 cur, 1 new)."""

    @classmethod
    def name(cls) -> str:
        return "maildir"

    def schema(self) -> str:
        return "uid bigint, flags int, name string, indir int"

    def reader(self, schema):
        return MaildirReader(self.options["path"])


@dataclass
class FolderState:
    """A state file: its headers and its pairs (fuid, nuid, flags); absent numbers are null in pairs, 0 in headers."""

    present: bool = False
    fuidval: int = 0
    nuidval: int = 0
    maxpulled: int = 0
    maxpushed: int = 0
    pairs: list[tuple[int | None, int | None, int]] = field(default_factory=list)


#: The headers as the file names them.
HEADERS = {"FarUidValidity": "fuidval", "NearUidValidity": "nuidval", "MaxPulledUid": "maxpulled", "MaxPushedUid": "maxpushed"}
_PAIR = re.compile(r"\s*(\d+)\s+(\d+)(?:\s+(\S+))?")


def read_state(path: str) -> FolderState:
    """A folder's state file; a missing one is a folder never synced.  Unknown headers and rows with fewer than two numbers are skipped."""
    out = FolderState()
    if not os.path.exists(path):
        return out
    out.present, inside = True, True
    with open(path, encoding="utf-8", newline="\n") as source:
        for line in source:
            if inside:
                if line[0] in "\r\n":
                    inside = False
                elif (m := re.match(r"(\w+)\s+(\d+)", line)) and m[1] in HEADERS:
                    setattr(out, HEADERS[m[1]], int(m[2]) & _U32)
            elif m := _PAIR.match(line):
                out.pairs.append(((int(m[1]) & _U32) or None, (int(m[2]) & _U32) or None, letter_bits(m[3] or "")))
    return out


def read_uid_validity(path: str) -> tuple[int, int] | None:
    """The validity and the last uid; null where the file is missing, an error where it does not hold two numbers."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as source:
        m = re.match(r"\s*(\d+)\s+(\d+)", source.read())
    if m is None:
        raise ValueError(f"cannot parse {path}")
    return int(m[1]), int(m[2])


#: The lines of a baseline file and what they hold.
BASELINE = {"UidValidity": ("uidval",), "UidNext": ("uidnext",), "Exists": ("exists",), "Modseq": ("modseq",), "Ghosts": ("ghosts",), "Local": ("nlocal",), "CurMtime": ("curs", "curn"), "NewMtime": ("news", "newn")}
BASELINE_HEAD, BASELINE_VERSION = "HmlState", 2


def read_baseline(path: str) -> dict[str, int] | None:
    """A baseline's numbers with its version; null where the file is missing.  Only version 2 is usable; `folders` looks at it."""
    if not os.path.exists(path):
        return None
    out = {"version": 0} | {c: 0 for names in BASELINE.values() for c in names}
    with open(path, encoding="utf-8") as source:
        for line in source:
            key, *numbers = line.split()
            names = ("version",) if key == BASELINE_HEAD else BASELINE.get(key, ())
            for name, number in zip(names, numbers):
                out[name] = int(number)
    return out


def ensure_maildir(path: str) -> None:
    """Creates a maildir and its parents, readable by the owner alone; folders that exist are left as they are."""
    at = "/" if path.startswith("/") else ""
    for part in path.strip("/").split("/"):
        at = os.path.join(at, part)
        if not os.path.isdir(at):
            os.mkdir(at, 0o700)
    for sub in ("cur", "new", "tmp"):
        if not os.path.isdir(os.path.join(path, sub)):
            os.mkdir(os.path.join(path, sub), 0o700)


def folder_mtimes(path: str) -> dict[str, int]:
    """Seconds and nanoseconds of the last change of cur and new; to be read before the scan."""
    out = {}
    for sub, a, b in (("cur", "curs", "curn"), ("new", "news", "newn")):
        at = os.stat(os.path.join(path, sub)).st_mtime_ns
        out[a], out[b] = divmod(at, 10**9)
    return out
