"""Edits of one file: plain Python on the driver, then an upsert of that path into the tables.

An edit names exactly one target: lines, a text that occurs once, or an anchor that occurs once. Line ends stay as the file
mostly has them; ``if_hash`` guards against edits of a file that has changed since.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

from ..sources.project import content_hash


class EditError(ValueError):
    pass


@dataclass
class Edit:
    """kind: replace, insert or delete. Lines count from 1; an insert at line n goes before it."""

    kind: str
    text: str = ""
    start: int | None = None
    end: int | None = None
    find: str | None = None
    before: str | None = None
    after: str | None = None


def safe_path(root: str, path: str) -> str:
    """The full path of a project path; none that leaves the root."""
    if os.path.isabs(path) or ".." in path.split("/"):
        raise EditError(f"{path} leaves the project")
    full = os.path.realpath(os.path.join(root, path))
    if not full.startswith(os.path.realpath(root) + os.sep):
        raise EditError(f"{path} leaves the project")
    return full


def _newline(content: str) -> str:
    crlf = content.count("\r\n")
    return "\r\n" if crlf > content.count("\n") - crlf else "\n"


def _once(content: str, text: str) -> int:
    n = content.count(text)
    if n != 1:
        raise EditError(f"the text occurs {n} times")
    return content.index(text)


def apply(content: str, edit: Edit, if_hash: str | None = None) -> str:
    """The content after an edit."""
    if if_hash is not None and if_hash.lower() != content_hash(content):
        raise EditError("the file has changed")
    targets = [edit.start is not None, edit.find is not None, edit.before is not None or edit.after is not None]
    if sum(targets) != 1 or (edit.before is not None and edit.after is not None):
        raise EditError("name exactly one target")
    newline = _newline(content)
    text = edit.text.replace("\r\n", "\n").replace("\n", newline)
    if edit.find is not None:
        if edit.kind == "insert":
            raise EditError("an insert needs a line or an anchor")
        find = edit.find.replace("\r\n", "\n").replace("\n", newline)
        at = _once(content, find)
        return content[:at] + (text if edit.kind == "replace" else "") + content[at + len(find) :]
    if edit.before is not None or edit.after is not None:
        if edit.kind != "insert":
            raise EditError("an anchor is for inserts")
        anchor = (edit.before if edit.before is not None else edit.after).replace("\n", newline)
        at = _once(content, anchor) + (0 if edit.before is not None else len(anchor))
        return content[:at] + text + content[at:]
    lines = content.splitlines(keepends=True)
    a, b = edit.start, edit.end if edit.end is not None else edit.start
    if edit.kind == "insert":
        if not 1 <= a <= len(lines) + 1:
            raise EditError("no such line")
        b = a - 1
    elif not 1 <= a <= b <= len(lines):
        raise EditError("no such lines")
    new = [] if edit.kind == "delete" else text.splitlines(keepends=True)
    if new and not new[-1].endswith("\n") and (b < len(lines) or (lines and lines[-1].endswith("\n"))):
        new[-1] += newline
    if edit.kind == "insert" and a == len(lines) + 1 and lines and not lines[-1].endswith("\n"):
        lines[-1] += newline
    return "".join(lines[: a - 1] + new + lines[b:])


def diff_stats(before: str, after: str) -> dict[str, int]:
    """First changed line, and lines taken out and put in, by common first and last lines."""
    a, b = before.splitlines(), after.splitlines()
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return {"first": head + 1, "removed": len(a) - head - tail, "added": len(b) - head - tail}


def write(full: str, content: str) -> None:
    """Replace a file at once, with the mode it had."""
    mode = os.stat(full).st_mode if os.path.exists(full) else None
    os.makedirs(os.path.dirname(full), exist_ok=True)
    fd, own = tempfile.mkstemp(dir=os.path.dirname(full))
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    if mode is not None:
        os.chmod(own, mode)
    os.replace(own, full)


def patch(root: str, path: str, edit: Edit, if_hash: str | None = None, dry_run: bool = False) -> dict:
    full = safe_path(root, path)
    with open(full, encoding="utf-8", newline="") as f:
        before = f.read()
    after = apply(before, edit, if_hash)
    if not dry_run:
        write(full, after)
    return {"path": path, "hash": content_hash(after), "changed": after != before, **diff_stats(before, after)}


def create(root: str, path: str, content: str, overwrite: bool = False, dry_run: bool = False) -> dict:
    full = safe_path(root, path)
    if os.path.exists(full) and not overwrite:
        raise EditError(f"{path} exists")
    if not dry_run:
        write(full, content)
    return {"path": path, "hash": content_hash(content)}
