"""Random access to files of any store, for readers of formats that Spark has no source for."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

import veldt

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(veldt.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="veldt-ship-")) / "veldt.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def store(uri: str):
    """The file system of a URI or a local path, and the path within it."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def opened(uri: str):
    """A seekable binary file; only what is read is fetched."""
    system, path = store(uri)
    return system.open_input_file(path)


def files(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """URI and size of the file, or of the files below a folder with one of the suffixes, by name; hidden ones are left out."""
    from pyarrow import fs

    system, path = store(uri)
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(head + path, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes) and not posixpath.basename(f.path).startswith((".", "_"))]
    return sorted((head + f.path, f.size) for f in kept)


@contextmanager
def published(uri: str) -> Iterator:
    """A binary file to write to, which gets its name when it is whole; a task that is run again writes it anew."""
    system, path = store(uri)
    staged = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.part-{uuid.uuid4().hex}")
    system.create_dir(posixpath.dirname(path), recursive=True)
    try:
        with system.open_output_stream(staged) as out:
            yield out
        system.move(staged, path)
    except BaseException:
        from pyarrow import fs

        if system.get_file_info(staged).type == fs.FileType.File:
            system.delete_file(staged)
        raise
