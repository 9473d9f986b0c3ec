"""Opening files inside tasks, on any storage the executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote


def _resolve(uri: str):
    """File system and path of a Spark file URI (percent-encoded, as in ``_metadata.file_path``)."""
    from pyarrow import fs

    if re.match(r"^file:/", uri) or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", unquote(uri))
    return fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """Seekable binary file object."""
    system, path = _resolve(uri)
    return system.open_input_file(path)


def read_start(uri: str, size: int) -> bytes:
    """The first ``size`` bytes."""
    system, path = _resolve(uri)
    with system.open_input_stream(path) as stream:
        return stream.read(size)


def write_stream(uri: str, chunks) -> int:
    """Write chunks to a file that appears only when complete; a re-run task replaces it with the same content."""
    system, path = _resolve(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with system.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(draft, path)
    return size


def _located(path: str):
    """File system and path of a readable path or URI, whose characters stand for themselves."""
    from pyarrow import fs

    if re.match(r"^file:/", path) or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    root, rest = re.match(r"^([^:]+://[^/]*)(/.*)$", path).groups()
    system, base = fs.FileSystem.from_uri(root)
    return system, f"{base.rstrip('/')}{rest}" if base else rest.lstrip("/")


def remove_file(path: str) -> bool:
    """Remove a file by its readable path; one that is gone already is no error."""
    try:
        system, place = _located(path)
        system.delete_file(place)
        return True
    except FileNotFoundError:
        return False


def move_file(path: str, target: str) -> bool:
    """Move a file by readable paths; False if it is gone. A repeated move leaves one file at the target."""
    system, place = _located(path)
    _, goal = _located(target)
    try:
        system.create_dir(goal.rsplit("/", 1)[0], recursive=True)
        system.move(place, goal)
        return True
    except FileNotFoundError:
        return False


def literal_path(path: str) -> str:
    """Escape glob characters, for a path that must be read as it is."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def path_exists(uri: str) -> bool:
    """True if a file or folder is there."""
    from pyarrow import fs

    system, path = _resolve(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def qualified(path: str) -> str:
    """A path as Spark's readers show it: local paths as ``file:///``."""
    return path.rstrip("/") if "://" in path else "file:///" + re.sub(r"^(file:)?/+", "", path).rstrip("/")


def _shown(root: str, place: str) -> str:
    """The readable path of a place in the file system of ``root``, a readable path too."""
    if root.startswith("file:/"):
        return "file:///" + place.lstrip("/")
    head = re.match(r"^([^:]+://[^/]*)", root)[1]
    _, base = _located(f"{head}/")
    return f"{head}/{place[len(base):].lstrip('/') if base and place.startswith(base) else place.lstrip('/')}"


def _below(path: str, recursive: bool) -> list:
    from pyarrow import fs

    system, place = _located(path)
    return system.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=recursive))


def list_folders(path: str) -> list[str]:
    """Folders in a folder, by readable paths; hidden ones are left out."""
    return sorted(_shown(path, i.path) for i in _below(path, False) if not i.is_file and i.base_name[:1] not in "._")


def list_files(path: str) -> list[str]:
    """The Parquet files below a folder, or the file itself; hidden ones are left out."""
    if path.endswith(".parquet"):
        return [path]
    found = (_shown(path, i.path) for i in _below(path, True) if i.is_file and i.base_name.endswith(".parquet"))
    return sorted(f for f in found if not re.search(r"/[._]", f[len(path.rstrip("/")):]))


def open_file_at(path: str):
    """Seekable binary file object of a readable path, or None if the file is gone."""
    system, place = _located(path)
    try:
        return system.open_input_file(place)
    except FileNotFoundError:
        return None


@contextmanager
def replace_file(path: str, alone: bool) -> Iterator:
    """A stream into a file that appears only when complete; ``alone``: other Parquet files of its folder are then removed."""
    system, place = _located(path)
    folder, name = place.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, place)
    if alone:
        for other in list_files(path.rsplit("/", 1)[0]):
            if not other.endswith(f"/{name}"):
                remove_file(other)
