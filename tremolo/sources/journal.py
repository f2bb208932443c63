"""Answers kept as soon as they are given, by the task that asked.

A journal is a folder of small files of JSON lines, written by tasks to a file system that pyarrow
knows by its URI. A task that is run again finds the answers of its first try; what a lost job leaves
is read by the next. Files are never changed, so a torn one costs its own lines.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyarrow import fs


class Journal:
    """The part of a journal, at a URI, that one task writes. ``keys`` name a line; ``every`` lines make a file."""

    def __init__(self, at: str, task: int, keys: list[str], every: int = 1):
        self.files, self.path = fs.FileSystem.from_uri(at)
        self.task, self.keys, self.every = task, keys, every
        self.lock, self.held, self.known = threading.Lock(), [], {}
        self.files.create_dir(self.path, recursive=True)
        for f in self.files.get_file_info(fs.FileSelector(self.path)):
            if f.base_name.startswith(f"{task}-"):
                with self.files.open_input_stream(f.path) as stream:
                    for line in stream.read().splitlines():
                        try:
                            row = json.loads(line)
                        except ValueError:  # torn
                            continue
                        self.known[tuple(row[k] for k in keys)] = row

    def recall(self, *key) -> dict | None:
        return self.known.get(key)

    def keep(self, row: dict) -> None:
        with self.lock:
            self.held.append(row)
            if len(self.held) >= self.every:
                self.flush()

    def flush(self) -> None:
        if self.held:
            with self.files.open_output_stream(f"{self.path}/{self.task}-{uuid.uuid4().hex}.jsonl") as stream:
                stream.write("".join(json.dumps(r) + "\n" for r in self.held).encode())
            self.held = []
