"""Putting one file in its place, whole or not at all."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def inside(folder: str, target: str) -> str:
    """The path of a target in a folder; raises for one that leads out of it."""
    if ".." in target.split("/"):
        raise ValueError(f"a target outside the folder: {target}")
    return posixpath.join(folder, target)


def put_file(store: fs.FileSystem, path: str, content: bytes, mime: str, made: set[str]) -> None:
    """Write so that readers never see half a file and a retried or speculative
    task only repeats the same content: in file systems under a temporary name
    and then moved, while object stores show an object only once complete.
    ``made`` remembers folders that exist."""
    folder, name = posixpath.split(path)
    if store.type_name not in ("local", "hdfs"):
        with store.open_output_stream(path, metadata={"Content-Type": mime}) as out:
            out.write(content)
        return
    if folder not in made:
        store.create_dir(folder, recursive=True)
        made.add(folder)
    draft = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    try:
        with store.open_output_stream(draft) as out:
            out.write(content)
        store.move(draft, path)
    except Exception:
        _discard(store, draft)
        raise


def _discard(store: fs.FileSystem, path: str) -> None:
    try:
        store.delete_file(path)
    except Exception:  # noqa: BLE001 - it may never have been created
        pass
