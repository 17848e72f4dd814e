"""Audit settings from TOML: unknown keys and thresholds that do not fit are refused."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from . import audit

RULES = ("architecture.cycle", "dependency.unresolved_import", "file.large", "symbol.large", "dependency.hotspot", "dead_code.candidate")
SETTINGS = ("off", "warning", "high")
THRESHOLDS = {"file_lines": audit.FILE_LINES, "symbol_lines": audit.SYMBOL_LINES, "fan_in": audit.FAN_IN, "fan_out": audit.FAN_OUT}


@dataclass
class AuditConfig:
    rules: dict[str, str] = field(default_factory=lambda: {r: "off" if r.startswith("dead") else "high" if r in RULES[:2] else "warning" for r in RULES})
    thresholds: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(THRESHOLDS))
    max_findings: int = audit.MAX_FINDINGS
    ignore_ids: list[str] = field(default_factory=list)
    ignore_paths: list[str] = field(default_factory=list)
    ignore_names: list[str] = field(default_factory=lambda: list(audit.IGNORED_NAMES))


def parse(text: str) -> AuditConfig:
    """Lists add to the defaults; a warning threshold may not be above its high one."""
    raw, out = tomllib.loads(text), AuditConfig()
    for key, value in raw.items():
        if key == "rules":
            for rule, setting in value.items():
                if rule not in RULES or setting not in SETTINGS:
                    raise ValueError(f"rules.{rule} = {setting!r}")
                out.rules[rule] = setting
        elif key == "thresholds":
            for name, pair in value.items():
                if name not in THRESHOLDS or set(pair) - {"warning", "high"}:
                    raise ValueError(f"thresholds.{name}")
                low, high = pair.get("warning", THRESHOLDS[name][0]), pair.get("high", THRESHOLDS[name][1])
                if low > high or low < 1:
                    raise ValueError(f"thresholds.{name}: {low} and {high}")
                out.thresholds[name] = (low, high)
        elif key == "max_findings":
            out.max_findings = int(value)
        elif key in ("ignore_ids", "ignore_paths", "ignore_names"):
            getattr(out, key).extend(value)
        else:
            raise ValueError(f"unknown key {key}")
    return out
