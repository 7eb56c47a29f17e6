"""Single-file output that appears whole or not at all."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator
from typing import IO

from tessella.errors import ArgumentError


def check_path(path: str) -> str:
    if not isinstance(path, (str, os.PathLike)) or not str(path).strip():
        raise ArgumentError("the path must not be blank")
    return os.fspath(path)


@contextlib.contextmanager
def replacing(path: str, mode: str = "w") -> Iterator[IO]:
    """Write beside ``path`` and move the result over it; a failure leaves an old file as it was."""
    folder = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"folder {folder} does not exist")
    handle, temp = tempfile.mkstemp(dir=folder, prefix=".tessella-", suffix=".tmp")
    try:
        options = {} if "b" in mode else {"encoding": "utf-8", "newline": ""}
        with os.fdopen(handle, mode, **options) as out:
            yield out
        os.chmod(temp, 0o644)
        os.replace(temp, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(temp)
        raise
