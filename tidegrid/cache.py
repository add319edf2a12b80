"""Snapshots of a session's channel metadata, for quick reopening.

Off unless asked for. A snapshot counts only while every file has the size and
time of change it had; subject fields are never stored, nor anything of
encrypted sessions.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from tidegrid.sources.bytesource import Directory
from tidegrid.sources.native import SUBJECTS, Session

VERSION = 1
_HIDDEN = (*SUBJECTS, "gmt_offset")


def place(session_path: str, cache: str | bool | None) -> Path | None:
    if cache in (None, False):
        return None
    if cache not in ("auto", True):
        return Path(cache)
    base = Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "tidegrid"
    key = hashlib.sha256(os.path.abspath(session_path).encode()).hexdigest()[:16]
    return base / f"{Path(session_path).stem}-{key}.json"


def fingerprint(session_path: str) -> dict[str, list[int]]:
    """Size and time of change of every file that the metadata come from."""
    path = os.path.abspath(session_path)
    files = [path] if os.path.isfile(path) else [os.path.join(path, n) for n in Directory(path).files()]
    return {f: [(s := os.stat(f)).st_size, s.st_mtime_ns] for f in sorted(files)}


def save(where: Path, session_path: str, session: Session) -> None:
    if any(s.keys.level for x in session.segments.values() for s in x):
        return
    infos = {c: {k: v for k, v in session.info(c).items() if k not in _HIDDEN} for c in session.channels}
    where.parent.mkdir(parents=True, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=where.parent)
    with os.fdopen(fd, "w") as f:
        json.dump({"version": VERSION, "path": os.path.abspath(session_path), "files": fingerprint(session_path), "infos": infos}, f)
    os.replace(part, where)


def load(where: Path, session_path: str) -> dict[str, dict] | None:
    """The channel infos of a snapshot that still holds, else None."""
    try:
        found = json.loads(where.read_text())
        holds = found["version"] == VERSION and found["path"] == os.path.abspath(session_path) and found["files"] == fingerprint(session_path)
        return found["infos"] if holds else None
    except (OSError, ValueError, KeyError):
        return None


def invalidate(session_path: str) -> None:
    place(session_path, "auto").unlink(missing_ok=True)
