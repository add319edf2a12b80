"""Where a session's bytes are: a directory, or one uncompressed tar of it. Archives are packed and unpacked here too."""

from __future__ import annotations

import os
import shutil
import tarfile
import tempfile

from tidegrid.model import FormatError, SessionIOError

SUFFIX, ARCHIVE = ".mefd", ".mefd.tar"
#: The first bytes of compressed files.
_PACKED = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd", b"PK\x03\x04": "zip"}


def has_suffix(path: str, suffix: str) -> bool:
    return path.rstrip("/").lower().endswith(suffix)


class Directory:
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.name = os.path.basename(self.path)[: -len(SUFFIX)]

    def files(self) -> dict[str, int]:
        """Sizes by path inside the session."""
        found = {}
        for d, _, names in os.walk(self.path):
            for n in names:
                full = os.path.join(d, n)
                found[os.path.relpath(full, self.path)] = os.path.getsize(full)
        return found

    def read(self, member: str, offset: int = 0, length: int = -1) -> bytes:
        try:
            with open(os.path.join(self.path, member), "rb") as f:
                f.seek(offset)
                data = f.read(length) if length >= 0 else f.read()
        except OSError as e:
            raise SessionIOError(f"cannot read {member}: {e}") from e
        if 0 <= length != len(data):
            raise SessionIOError(f"{member} ends early")
        return data

    def describe(self, member: str) -> str:
        return os.path.join(self.path, member)


class Tar:
    """Members are read in place, by offset; nothing is unpacked."""

    def __init__(self, path: str):
        self.path = path
        self.name = os.path.basename(path)[: -len(ARCHIVE)]
        try:
            with open(path, "rb") as f:
                head = f.read(6)
        except OSError as e:
            raise SessionIOError(f"cannot read {path}: {e}") from e
        for magic, kind in _PACKED.items():
            if head.startswith(magic):
                raise FormatError(f"{path} is compressed ({kind}); only plain tar archives can be read in place")
        members = {}
        try:
            with tarfile.open(path, "r:") as t:
                for m in t:
                    if m.isfile():
                        members[m.name.removeprefix("./").strip("/")] = (m.offset_data, m.size)
        except (tarfile.TarError, OSError) as e:
            raise FormatError(f"{path} is not a tar archive: {e}") from e
        tops = {n.split("/", 1)[0] for n in members}
        root = f"{next(iter(tops))}/" if len(tops) == 1 and has_suffix(next(iter(tops)), SUFFIX) else ""
        if root:
            self.name = root[: -len(SUFFIX) - 1]
        self.members = {n.removeprefix(root): v for n, v in members.items()}

    def files(self) -> dict[str, int]:
        return {n: size for n, (_, size) in self.members.items()}

    def read(self, member: str, offset: int = 0, length: int = -1) -> bytes:
        if member not in self.members:
            raise SessionIOError(f"no {member} in {self.path}")
        at, size = self.members[member]
        length = size - offset if length < 0 else length
        if offset + length > size:
            raise SessionIOError(f"{member} ends early")
        with open(self.path, "rb") as f:
            f.seek(at + offset)
            return f.read(length)

    def describe(self, member: str) -> str:
        return f"{self.path}::{member}"


def source(path: str) -> Directory | Tar:
    path = str(path)
    if os.path.isdir(path):
        if not has_suffix(path, SUFFIX):
            raise SessionIOError(f"a session directory's name ends in {SUFFIX}: {path}")
        return Directory(path)
    if os.path.isfile(path):
        if not has_suffix(path, ARCHIVE):
            raise SessionIOError(f"a session archive's name ends in {ARCHIVE}: {path}")
        return Tar(path)
    raise SessionIOError(f"no session at {path}")


def archive_session(session_path: str, tar_path: str | None = None, overwrite: bool = False) -> str:
    """One plain tar, the same bytes for the same session: entries by path, no owners or times. Renamed into place when whole."""
    session_path = str(session_path).rstrip("/")
    if not os.path.isdir(session_path) or not has_suffix(session_path, SUFFIX):
        raise SessionIOError(f"not a session directory: {session_path}")
    target = os.path.abspath(str(tar_path) if tar_path else session_path + ".tar")
    if not has_suffix(target, ARCHIVE):
        raise SessionIOError(f"an archive's name ends in {ARCHIVE}: {target}")
    if (target + os.sep).startswith(os.path.abspath(session_path) + os.sep):
        raise SessionIOError("an archive cannot lie inside the session that it packs")
    if os.path.exists(target) and not overwrite:
        raise SessionIOError(f"{target} exists")

    def plain(m: tarfile.TarInfo) -> tarfile.TarInfo:
        m.uid = m.gid = m.mtime = 0
        m.uname = m.gname = ""
        m.mode = 0o755 if m.isdir() else 0o644
        return m

    root = os.path.basename(session_path)
    paths = sorted(os.path.relpath(os.path.join(d, n), session_path) for d, dirs, names in os.walk(session_path) for n in (*dirs, *names))
    part = f"{target}.part{os.getpid()}"
    try:
        with tarfile.open(part, "w:", format=tarfile.GNU_FORMAT) as t:
            t.add(session_path, root, recursive=False, filter=plain)
            for p in paths:
                t.add(os.path.join(session_path, p), f"{root}/{p}", recursive=False, filter=plain)
        os.replace(part, target)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise
    return target


def extract_session(tar_path: str, dest_dir: str | None = None, overwrite: bool = False) -> str:
    """The session directory of an archive. Unpacked beside its place and renamed when whole; names that lead out are refused."""
    src = Tar(str(tar_path))
    target = os.path.abspath(str(dest_dir) if dest_dir else str(tar_path)[: -len(".tar")])
    if not has_suffix(target, SUFFIX):
        raise SessionIOError(f"a session directory's name ends in {SUFFIX}: {target}")
    if os.path.exists(target):
        if not overwrite:
            raise SessionIOError(f"{target} exists")
        if not os.path.isdir(target):
            raise SessionIOError(f"{target} is not a directory")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = tempfile.mkdtemp(prefix=".unpack-", dir=os.path.dirname(target))
    try:
        for name in src.files():
            if name.startswith("/") or ".." in name.split("/"):
                raise FormatError(f"the archive's entry {name} leads out of it")
            out = os.path.join(part, name)
            os.makedirs(os.path.dirname(out), exist_ok=True)
            with open(out, "wb") as f:
                f.write(src.read(name))
        if os.path.exists(target):
            shutil.rmtree(target)
        os.rename(part, target)
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise
    return target
