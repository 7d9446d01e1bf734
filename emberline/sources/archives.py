"""Fetching and unpacking exports, once."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator


def fetched(target: str, read: Callable[[], Iterator[bytes]]) -> bool:
    """Write what read yields to target unless it is there and not empty; whether it was written. A broken transfer leaves no target."""
    if os.path.exists(target) and os.path.getsize(target):
        return False
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    part = f"{target}.part"
    with open(part, "wb") as out:
        for chunk in read():
            out.write(chunk)
    os.replace(part, target)
    return True


def unpacked(archive: str, root: str, marker: str = "data.yaml") -> bool:
    """Unpack a ZIP file below root unless its descriptor is there; whether it was unpacked. Members that would leave root are refused."""
    if os.path.exists(os.path.join(root, marker)):
        return False
    base = os.path.realpath(root)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if os.path.commonpath([base, os.path.realpath(os.path.join(base, name))]) != base:
                raise ValueError(f"{archive}: {name} leaves the folder")
        z.extractall(base)
    return True
