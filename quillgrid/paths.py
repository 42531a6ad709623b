"""Confinement of the command line's paths to a workspace."""

from __future__ import annotations

import os
from pathlib import Path

from .errors import EngineError


#: Names that some systems reserve for devices, with any ending.
DEVICES = frozenset(["CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$", *(f"{port}{n}" for port in ("COM", "LPT") for n in "123456789¹²³")])


def check_name(name: str) -> None:
    """Refuse names that some system takes for a device or stream, or shortens to another name."""
    stem = name.partition(".")[0].rstrip(" ").upper()
    if ":" in name or name[-1:] in (" ", ".") or stem in DEVICES:
        raise EngineError(f"{name!r} is no name for a file")


def within(value: str | os.PathLike, workspace: str | os.PathLike) -> Path:
    """The real path of value, which must lie in the workspace, links resolved; links must lead to something."""
    root = Path(workspace).resolve(strict=True)
    if not root.is_dir():
        raise EngineError("the workspace is no folder")
    text = os.fspath(value)
    if "\0" in text or not text:
        raise EngineError("not a path")
    if text.startswith(("\\\\", "//")):
        raise EngineError("device and network paths are refused")
    path = root / text
    for name in path.relative_to(root).parts if path.is_relative_to(root) else Path(text).parts[1:]:
        if name not in (".", ".."):
            check_name(name)
    if any(p.is_symlink() and not p.exists() for p in (path, *path.parents)):
        raise EngineError(f"{text} goes through a link that leads nowhere")
    path = path.resolve()
    if path != root and root not in path.parents:
        raise EngineError(f"{text} lies outside of the workspace")
    return path
