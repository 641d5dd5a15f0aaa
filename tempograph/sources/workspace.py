"""Workspaces on the driver: descriptor, layered configuration, stage cache."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import time

SCHEMA_VERSION, STALE_SECONDS = 1, 24 * 3600


def read_config(path: str) -> dict:
    """A layer of ``section: {name: value}`` written as JSON or as indented name: value lines; missing or blank is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not text.strip():
        return {}
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    section = out
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, _, value = line.strip().partition(":")
        target = section if line[0] in " \t" else out
        if not value.strip():
            section = target[name] = {}
        else:
            target[name] = parse_value(value.strip())
    return out


def parse_value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def overlay(*layers: dict) -> dict:
    """The last layer that says anything wins, leaf by leaf."""
    out: dict = {}
    for layer in layers:
        for name, value in layer.items():
            out[name] = overlay(out.get(name) or {}, value) if isinstance(value, dict) else out.get(name) if value is None else value
    return out


def write_atomically(path: str, data: bytes) -> None:
    """A temporary file beside it, then a move."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".staging-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def file_digest(path: str) -> str:
    """R3."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def create_workspace(root: str, source: str, title: str = "", artist: str = "") -> dict:
    """X11: a folder with a descriptor of its source; nothing is left if that fails."""
    os.makedirs(root, exist_ok=False)
    try:
        found = {"schemaVersion": SCHEMA_VERSION, "source": {"name": os.path.basename(source), "sha256": file_digest(source)}, "createdAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "title": title, "artist": artist, "config": {}}
        write_atomically(os.path.join(root, "workspace.json"), json.dumps(found, indent=2).encode())
        return found
    except BaseException:
        os.rmdir(root)
        raise


def open_workspace(root: str) -> dict:
    """The descriptor; a newer schema is refused."""
    with open(os.path.join(root, "workspace.json"), encoding="utf-8") as f:
        found = json.load(f)
    if found.get("schemaVersion", 0) > SCHEMA_VERSION:
        raise ValueError("the workspace was written by a newer version")
    return found


class StageCache:
    """Results of stages by key, as files."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def path(self, stage: str, key: str) -> str:
        name = re.sub("[^A-Za-z0-9._-]", "_", stage)
        return os.path.join(self.root, f"{'_' if name in ('', '.', '..') else name}-{key}")

    def find(self, stage: str, key: str) -> bytes | None:
        try:
            with open(self.path(stage, key), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, stage: str, key: str, data: bytes) -> None:
        write_atomically(self.path(stage, key), data)

    def invalidate(self, stage: str) -> int:
        prefix = os.path.basename(self.path(stage, ""))
        gone = [f for f in os.listdir(self.root) if f.startswith(prefix)]
        for f in gone:
            os.unlink(os.path.join(self.root, f))
        return len(gone)

    def sweep(self, now: float | None = None) -> int:
        """Staging files that are older than a day go."""
        old = [p for f in os.listdir(self.root) if f.startswith(".staging-") and (now or time.time()) - os.path.getmtime(p := os.path.join(self.root, f)) > STALE_SECONDS]
        for p in old:
            os.unlink(p)
        return len(old)


def free_name(stamp: str, taken: set[str]) -> str:
    """Stamp, or stamp-2, stamp-3 and so on."""
    n, name = 1, stamp
    while name in taken:
        n += 1
        name = f"{stamp}-{n}"
    return name


def newest_first(takes: list[tuple[str, float]]) -> list[str]:
    """Names by time, newest first, then by name."""
    return [name for name, _ in sorted(takes, key=lambda t: (-t[1], t[0]))]
