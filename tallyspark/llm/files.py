"""Raw files written by tasks into the shared folder: a temporary name first, then the final one, then a manifest."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """A stream to a file that gets its name only once it is whole; a task that is run again replaces it by the same bytes."""
    store, path = opened(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(f"{folder}/_temporary", recursive=True)
    temporary = f"{folder}/_temporary/{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as stream:
        yield stream
    store.move(temporary, path)


def write_manifest(folder: str, files: DataFrame, **more: dict) -> None:
    """manifest.json in folder: one entry for each file (not for each record) and those of more, written after all of them."""
    rows = [r.asDict() for r in files.orderBy(*files.columns[:2]).toLocalIterator()]
    with new_file(f"{folder}/manifest.json") as stream:
        stream.write(json.dumps({"files": rows, **more}).encode())


def read_whole(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as stream:
        return stream.read()


def manifest(folder: str) -> dict:
    return json.loads(read_whole(f"{folder}/manifest.json"))


def read_manifest(folder: str) -> list[dict]:
    return manifest(folder)["files"]
