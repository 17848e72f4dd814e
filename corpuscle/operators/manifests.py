"""Outlines of manifests and settings: package.json, TOML, Cargo.toml, YAML. Each gives (name, kind, line, detail) of its lines."""

from __future__ import annotations

import re

# fixed values: sections of package.json, with the kind and detail of their entries
PACKAGE_SECTIONS = {
    "scripts": ("constant", "npm script"),
    "dependencies": ("constant", "dependency"),
    "devDependencies": ("constant", "dev dependency"),
    "peerDependencies": ("constant", "peer dependency"),
    "workspaces": ("module", "workspace"),
    "exports": ("constant", "exports"),
    "bin": ("constant", "bin"),
}
# fixed values: Cargo.toml's sections of dependencies, its metadata and its targets
CARGO_DEPENDENCIES = ("dependencies", "dev-dependencies", "build-dependencies")
CARGO_METADATA = ("name", "version", "edition")
CARGO_TARGETS = ("bin", "example", "test", "bench")
_KEY, _TEXT = re.compile(r'"([^"]+)"\s*:'), re.compile(r'"([^"]+)"')


def package_json(lines: list[str]):
    section = None
    for i, raw in enumerate(lines, 1):
        line = raw.strip()
        if line[:1] in ("}", "]"):
            section = None
        elif m := _KEY.match(line):
            if m[1] in PACKAGE_SECTIONS:
                section = m[1]
                yield m[1], "module", i, "package manifest section"
            elif section:
                yield m[1], PACKAGE_SECTIONS[section][0], i, PACKAGE_SECTIONS[section][1]
        elif section == "workspaces" and (m := _TEXT.match(line)):
            yield m[1], "module", i, "workspace"


def _bare(key: str) -> str:
    return key.strip().strip("\"'")


def toml(lines: list[str], cargo: bool = False):
    section = ""
    for i, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or line.startswith(("#", "//")):
            continue
        if m := re.match(r"\[+\s*([^\]]+?)\s*\]+", line):
            section = _bare(m[1])
            yield section, "module", i, "toml section"
            continue
        key, equals, value = line.partition("=")
        key = _bare(key)
        if not equals or not key:
            continue
        if not cargo:
            yield key, "constant", i, section or None
        elif section == "package" and key in CARGO_METADATA:
            yield key, "constant", i, "package metadata"
        elif section in CARGO_DEPENDENCIES:
            yield key, "import", i, section
        elif section == "features":
            yield key, "constant", i, "feature"
        elif section == "workspace" and key == "members":
            for name in _TEXT.findall(line):
                yield name, "module", i, "workspace member"
        elif section.startswith(CARGO_TARGETS) and key == "name" and (m := _TEXT.search(value)):
            yield m[1], "module", i, section


def yaml(lines: list[str]):
    """Keys with those that they stand under, by indentation."""
    above: list[tuple[int, str]] = []
    for i, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or line.startswith(("#", "//")) or ":" not in line:
            continue
        name = _bare(line.split(":", 1)[0].removeprefix("- "))
        if not re.fullmatch(r"[\w.$/-]+", name):
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        while above and above[-1][0] >= indent:
            above.pop()
        above.append((indent, name))
        yield ".".join(n for _, n in above), "constant", i, None


def scanner(language: str, path: str):
    """The scanner of a file, or None if it is no manifest."""
    name = path.rsplit("/", 1)[-1]
    if name == "package.json":
        return package_json
    if language == "toml":
        return lambda lines: toml(lines, name == "Cargo.toml")
    return yaml if language == "yaml" else None
