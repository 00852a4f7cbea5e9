"""The TOML configuration of the command line."""

from __future__ import annotations

import os
import sys
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from marlstone.errors import InvalidInput

KEY_VARIABLE = "MARLSTONE_API_KEY"
FOLDER, LEGACY = ".config/marlstone", ".marlstone"


@dataclass
class Config:
    store: str = "marlstone-store"
    endpoint: str = ""
    model: str = ""
    dimension: int = 0
    api_key_env: str | None = None
    api_key: str | None = field(default=None, repr=False)


def default_path(home: str | None = None) -> Path:
    """The preferred place, or the old one with a warning if only that exists."""
    home = home or os.environ.get("HOME") or os.environ.get("USERPROFILE")
    if not home:
        raise InvalidInput("neither HOME nor USERPROFILE is set")
    preferred, legacy = Path(home, FOLDER, "config.toml"), Path(home, LEGACY, "config.toml")
    if not preferred.exists() and legacy.exists():
        print(f"warning: using legacy config path {legacy}", file=sys.stderr)
        return legacy
    return preferred


def load(explicit: str | None = None) -> Config:
    path = Path(explicit) if explicit else default_path()
    try:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
    except FileNotFoundError:
        if explicit:
            raise InvalidInput(f"config file not found: {path}") from None
        return Config()
    except tomllib.TOMLDecodeError as e:
        raise InvalidInput(f"config file {path}: {e}") from None
    storage, embedding = data.get("storage", {}), data.get("embedding", {})
    return Config(
        store=os.path.expanduser(storage.get("path", Config.store)),
        endpoint=embedding.get("endpoint", ""),
        model=embedding.get("model", ""),
        dimension=int(embedding.get("dimension", 0)),
        api_key_env=embedding.get("api_key_env"),
        api_key=embedding.get("api_key"),
    )


def resolve_key(config: Config, lookup: Callable[[str], str | None] = os.environ.get) -> str | None:
    """The named variable, the usual one, then the file. An empty string counts as unset."""
    named = lookup(config.api_key_env) if config.api_key_env else None
    return named or lookup(KEY_VARIABLE) or config.api_key or None
