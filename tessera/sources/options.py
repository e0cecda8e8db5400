"""Engine options: defaults, then file, then environment, then what the caller gives."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    cache_ttl_ms: int = 24 * 3_600_000
    hint_ttl_ms: int = 24 * 3_600_000
    most_at_once: int = 2
    least_apart_ms: int = 500
    idle_ms: int = 600_000
    most_sessions: int = 5
    page_chars: int = 40_000
    content_chars: int = 8_000
    allow_private: bool = False


#: Never taken from a file: what opens the own network must be said by the caller. Fixed values.
NOT_FROM_FILE = frozenset(("allow_private",))


def load_options(file: str | None = None, environment: Mapping[str, str] | None = None, **given: object) -> Options:
    """The options; unknown names in a file are ignored, a value of the wrong type is an error."""
    options = Options()
    kinds = {f.name: type(getattr(options, f.name)) for f in fields(options)}
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as lines:
            said = json.load(lines)
        options = replace(options, **{k: _as(kinds[k], v) for k, v in said.items() if k in kinds and k not in NOT_FROM_FILE})
    environment = os.environ if environment is None else environment
    named = {f"TESSERA_{k.upper()}": k for k in kinds}
    options = replace(options, **{named[k]: _as(kinds[named[k]], v) for k, v in environment.items() if k in named})
    return replace(options, **{k: _as(kinds[k], v) for k, v in given.items()})


def _as(kind: type, value: object) -> object:
    if kind is bool:
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "1", "false", "0"):
            return str(value).lower() in ("true", "1")
    elif not isinstance(value, bool) and str(value).lstrip("-").isdigit() and int(str(value)) >= 0:
        return int(str(value))
    raise ValueError(f"not a {kind.__name__}: {value!r}")
