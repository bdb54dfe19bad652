"""Tunable decisions, validated once, and a fingerprint of everything that shapes a run's output."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A setting is missing or can't be used; the message names it."""


@dataclass(frozen=True)
class Policy:
    reconcile_tolerance: float = 0.01
    reference_tolerance: float = 0.15
    required_columns: tuple[str, ...] = ("TXN_ID", "ACCOUNT_ID", "TXN_DATE_TIME_CLEANED", "TXN_AMOUNT_CLEANED", "TXN_CCY")
    processing_code_width: int = 2
    mcc_width: int = 4
    auth_repeat_threshold: int = 2
    business_keys: tuple[tuple[str, ...], ...] = field(
        default=(("ACCOUNT_ID", "TXN_DATE_TIME", "TXN_AMOUNT", "MERCHANT_NAME"), ("ACCOUNT_ID", "TXN_DATE_TIME", "TXN_AMOUNT"))
    )


#: Where each setting stands in a policy file: section, key and kind.
LAYOUT = {
    "reconcile_tolerance": ("fx", "reconcile_tolerance", float),
    "reference_tolerance": ("fx", "reference_tolerance", float),
    "required_columns": ("validation", "required_columns", list),
    "processing_code_width": ("codes", "processing_code_width", int),
    "mcc_width": ("codes", "mcc_width", int),
    "auth_repeat_threshold": ("missing", "auth_repeat_threshold", int),
    "business_keys": ("duplicates", "business_keys", tuple),
}


def _names(value: Any, where: str) -> tuple[str, ...]:
    if not isinstance(value, list | tuple) or not value or not all(isinstance(x, str) and x.strip() for x in value):
        raise ConfigError(f"{where}: a list of column names is needed, not {value!r}")
    return tuple(value)


def from_mapping(data: Any) -> Policy:
    """A policy from a parsed file; every section and key must be there and usable."""
    if not isinstance(data, dict):
        raise ConfigError(f"policy: a mapping is needed, not {data!r}")
    found = {}
    for name, (section, key, kind) in LAYOUT.items():
        where = f"{section}.{key}"
        if not isinstance(data.get(section), dict):
            raise ConfigError(f"missing section {section!r}")
        if key not in data[section]:
            raise ConfigError(f"missing key {where!r}")
        value = data[section][key]
        if kind in (int, float):
            if isinstance(value, bool) or not isinstance(value, int | float) or value <= 0 or (kind is int and value != int(value)):
                raise ConfigError(f"{where}: a number above zero is needed, not {value!r}")
            found[name] = kind(value)
        elif kind is list:
            found[name] = _names(value, where)
        else:
            if not isinstance(value, list | tuple) or not value:
                raise ConfigError(f"{where}: groups of column names are needed, not {value!r}")
            found[name] = tuple(_names(group, where) for group in value)
    return Policy(**found)


@lru_cache(maxsize=1)
def default_policy() -> Policy:
    return Policy()


def load(path: str | Path) -> Policy:
    """A policy from a JSON or, where a YAML reader is installed, YAML file."""
    return from_mapping(read_config(path))


def read_config(path: str | Path) -> Any:
    path = Path(path)
    if not path.exists():
        raise ConfigError(f"no such file: {path}")
    raw = path.read_text(encoding="utf-8")
    try:
        if path.suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError:
                raise ConfigError(f"{path}: no YAML reader is installed; use JSON") from None
            return yaml.safe_load(raw)
        return json.loads(raw)
    except (ValueError, TypeError) as e:
        raise ConfigError(f"{path}: {e}") from e


@dataclass(frozen=True)
class Runtime:
    """Where a run reads and writes; not part of the fingerprint. The source need not exist yet."""

    source: str
    output: str


def runtime(data: Any) -> Runtime:
    paths = data.get("paths") if isinstance(data, dict) else None
    if not isinstance(paths, dict):
        raise ConfigError("missing section 'paths'")
    for key in ("source", "output"):
        if not isinstance(paths.get(key), str) or not paths[key].strip():
            raise ConfigError(f"paths.{key}: a path is needed, not {paths.get(key)!r}")
    return Runtime(paths["source"], paths["output"])


def canonical(value: Any) -> str:
    """The value as text that depends on its meaning only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=list)


def fingerprint(policy: Policy | None = None, master: dict | None = None, macro: dict | None = None) -> str:
    """SHA-256 over the policy and every vocabulary; equal meanings have equal fingerprints."""
    from veridra import rules

    parts: dict[str, Any] = {"policy": asdict(policy or default_policy()), "macro": macro or {}}
    parts["rules"] = {k: v for k, v in vars(rules).items() if k.isupper() and k != "MASTER"}
    parts["master"] = rules.MASTER if master is None else master
    digest = hashlib.sha256()
    for name in sorted(parts):
        digest.update(name.encode() + b"\0" + canonical(parts[name]).encode() + b"\0")
    return digest.hexdigest()


def short_fingerprint(**config) -> str:
    return fingerprint(**config)[:12]
