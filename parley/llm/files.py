"""Files that tasks write and read themselves, on any file system that pyarrow knows."""

import uuid
from collections.abc import Callable

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_whole(uri: str, fill: Callable) -> None:
    """Writes a file under another name and moves it into place, so a task that is lost or runs twice leaves one whole file."""
    system, path = _open(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        fill(out)
    system.move(draft, path)


def reader(uri: str):
    """A file for random reads; a local one is mapped into memory."""
    system, path = _open(uri)
    if isinstance(system, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path)
    return system.open_input_file(path)


def stream(uri: str):
    system, path = _open(uri)
    return system.open_input_stream(path, compression=None)
