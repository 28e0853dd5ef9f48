"""Settings of jobs: typed declarations, substitution of ${name}, merging of nested mappings. Plain Python, on the driver."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import types
import typing
from collections.abc import Mapping
from pathlib import Path


def substitute(value: object, params: Mapping[str, object]) -> object:
    """Replace ${name} by a parameter, else an environment variable; a name that neither has is an error.

    A text that is one ${name} only takes the parameter's own type.
    """
    if isinstance(value, Mapping):
        return {k: substitute(v, params) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, params) for v in value]
    if not isinstance(value, str):
        return value

    def find(name: str) -> object:
        if name in params:
            return params[name]
        if name in os.environ:
            return os.environ[name]
        raise KeyError(f"no value for ${{{name}}}")

    whole = re.fullmatch(r"\$\{(\w+)\}", value)
    return find(whole[1]) if whole else re.sub(r"\$\{(\w+)\}", lambda m: str(find(m[1])), value)


def merged(base: Mapping, over: Mapping) -> dict:
    """A mapping with another one's entries over it, level by level."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def subsample_size(n: int, base: int = 10_000, share: float = 0.1) -> int:
    """All of a small table; of a larger one, `base` rows and a share of the rest."""
    return n if n <= base else base + int(share * (n - base))


def candidate_ratios(base: list[float]) -> list[list[float]]:
    """Candidates of a sweep: the base, and the base a half larger and three tenths smaller."""
    return [base, [1.5 * b for b in base], [0.7 * b for b in base]]


# --- declared settings


def setting(default: object = dataclasses.MISSING, *, least: float | None = None, most: float | None = None, among: tuple | None = None, items: tuple[int, int] | None = None):
    """A field of a declaration: bounds of a number (or of each number of a list), allowed values, and how many items a list may have.

    Without a default it is required.
    """
    rules = {"least": least, "most": most, "among": among, "items": items}
    if isinstance(default, list | dict):
        return dataclasses.field(default_factory=lambda: type(default)(default), metadata=rules)
    return dataclasses.field(default=default, metadata=rules) if default is not dataclasses.MISSING else dataclasses.field(metadata=rules)


class SettingsError(ValueError):
    """All faults of a configuration, by their place."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


def _of_kind(value: object, kind: object, at: str, rules: Mapping, faults: list[str]) -> object:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        return _of_kind(value, next(a for a in args if a is not type(None)), at, rules, faults)
    if dataclasses.is_dataclass(kind):
        return _declared(kind, value, at, faults)
    if origin is list:
        if not isinstance(value, list):
            faults.append(f"{at}: a list is wanted, not {type(value).__name__}")
            return value
        if rules.get("items") and not rules["items"][0] <= len(value) <= rules["items"][1]:
            faults.append(f"{at}: {rules['items'][0]} to {rules['items'][1]} items are wanted, not {len(value)}")
        return [_of_kind(v, args[0], f"{at}[{i}]", rules, faults) for i, v in enumerate(value)]
    if kind is float and type(value) is int:
        value = float(value)
    if type(value) is not kind:  # True is no number here
        faults.append(f"{at}: {kind.__name__} is wanted, not {type(value).__name__}")
        return value
    if rules.get("among") is not None and value not in rules["among"]:
        faults.append(f"{at}: {value!r} is none of {list(rules['among'])}")
    if rules.get("least") is not None and value < rules["least"]:
        faults.append(f"{at}: {value} is below {rules['least']}")
    if rules.get("most") is not None and value > rules["most"]:
        faults.append(f"{at}: {value} is above {rules['most']}")
    return value


def _declared(kind: type, value: object, at: str, faults: list[str]) -> object:
    if not isinstance(value, Mapping):
        faults.append(f"{at or 'settings'}: a mapping is wanted, not {type(value).__name__}")
        return value
    known = {f.name: f for f in dataclasses.fields(kind)}
    faults += [f"{at}{'.' if at else ''}{k}: no such setting" for k in value if k not in known]
    hints, made = typing.get_type_hints(kind), {}
    for name, f in known.items():
        place = f"{at}{'.' if at else ''}{name}"
        if name in value:
            made[name] = _of_kind(value[name], hints[name], place, f.metadata, faults)
        elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            faults.append(f"{place}: is required")
    return kind(**made) if not faults else None


def read_settings(kind: type, given: Mapping | str | Path, params: Mapping[str, object] | None = None):
    """A declaration (a dataclass of settings) filled from a mapping or a JSON file, with ${name} substituted.

    Unknown keys, missing ones, other types and values out of bounds are errors, all told at once.
    """
    value = json.loads(Path(given).read_text(encoding="utf-8")) if isinstance(given, str | Path) else given
    faults: list[str] = []
    made = _declared(kind, substitute(value, params or {}), "", faults)
    if faults:
        raise SettingsError(faults)
    return made
