"""Content identity and lineage of files (driver side)."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_sha256(path: str) -> str:
    """Of a folder: the digest of its list of relative paths and digests, as compact JSON sorted by path."""
    base = Path(path)
    if base.is_file():
        return file_sha256(path)
    found = sorted((p.relative_to(base).as_posix(), str(p)) for p in base.rglob("*") if p.is_file())
    listed = [{"path": name, "sha256": file_sha256(p)} for name, p in found]
    return hashlib.sha256(json.dumps(listed, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Artifact:
    """What a file is (by content), where it lies, and what it was made from."""

    id: str
    sha256: str
    location: str
    source: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, path: str, name: str | None = None, source: list[str] | None = None) -> Artifact:
        digest = tree_sha256(path)
        return cls(f"{name or os.path.basename(path)}@sha256:{digest}", digest, path, list(source or []))

    def verify(self) -> None:
        if tree_sha256(self.location) != self.sha256:
            raise ValueError(f"{self.location} does not match its sha256")

    def record(self) -> dict:
        return asdict(self)


def pinned(data: bytes, path: str, md5: str) -> str:
    """Write data that has the given MD5, at once or not at all."""
    if hashlib.md5(data).hexdigest() != md5:
        raise ValueError(f"{path}: the data's MD5 isn't {md5}")
    Path(f"{path}.pending").write_bytes(data)
    os.replace(f"{path}.pending", path)
    return path
