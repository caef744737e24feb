"""Typed settings, overridden by name or by ``settings.name``."""

from __future__ import annotations

import typing
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class TrainSettings:
    batching: str = "padding"
    batch: int = 16
    val_batch: int = 1
    chunk: int = 4096
    ranks: int = 1
    rank: int = 0
    most_steps: int = 0
    lr: float = 2e-5
    seed: int = 42


@dataclass(frozen=True)
class DataSettings:
    dataset: str = "training_rows"
    file: str = ""
    pad: int = 0
    max_length: int = 4096
    drop_last: bool = True


_WORDS = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}


def _typed(settings, name: str, value):
    """A value as the field has it; texts, as a command line gives them, are read."""
    kind = typing.get_type_hints(type(settings))[name]
    if isinstance(value, str) and kind is not str:
        try:
            return _WORDS[value.lower()] if kind is bool else kind(value)
        except (KeyError, ValueError):
            raise ValueError(f"{type(settings).__name__}.{name} is no {kind.__name__}: {value!r}") from None
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if type(value) is not kind:
        raise ValueError(f"{type(settings).__name__}.{name} is no {kind.__name__}: {value!r}")
    return value


def updated(settings, **changes):
    """``settings`` (one, or several in a tuple) with changed fields: ``name`` changes it in all that have it, ``Type.name`` in one.

    A field that the named type lacks, and a name that no settings have, is left out with a warning.
    """
    several = settings if isinstance(settings, tuple) else (settings,)
    used, out = set(), []
    for s in several:
        mine = {f.name for f in fields(s)}
        found = {}
        for key, value in changes.items():
            of, _, name = key.rpartition(".")
            if of and of != type(s).__name__:
                continue
            if name in mine:
                found[name] = _typed(s, name, value)
                used.add(key)
            elif of:
                warnings.warn(f"{of} has no {name}", stacklevel=2)
                used.add(key)
        out.append(replace(s, **found))
    for key in changes.keys() - used:
        warnings.warn(f"no settings have {key}", stacklevel=2)
    return tuple(out) if isinstance(settings, tuple) else out[0]


def from_words(words: Iterable[str]) -> dict[str, str]:
    """Changes out of words such as ``--name=value`` and ``--Type.name=value``."""
    out = {}
    for w in words:
        name, equals, value = w.removeprefix("--").partition("=")
        if not w.startswith("--") or not equals or not name:
            raise ValueError(f"{w!r} is no --name=value")
        out[name] = value
    return out
