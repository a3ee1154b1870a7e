"""Settings and health; reading them has no side effects."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from . import __version__


@dataclass
class SplitConfig:
    n_splits: int = 5
    golden_train_size: int = 5000
    golden_val_size: int = 1000
    seed: int = 42
    target_col: str = "entity_value"

    def __post_init__(self) -> None:
        if self.n_splits < 2 or self.golden_train_size < 100 or self.golden_val_size < 50:
            raise ValueError("n_splits >= 2, golden_train_size >= 100 and golden_val_size >= 50 are needed")


@dataclass
class StoreConfig:
    bucket: str = field(default_factory=lambda: os.environ.get("TESSERA_BUCKET", ""))
    region: str = field(default_factory=lambda: os.environ.get("TESSERA_REGION", "us-east-1"))


@dataclass
class Config:
    root: Path = field(default_factory=lambda: Path(os.environ.get("TESSERA_ROOT", ".")))
    split: SplitConfig = field(default_factory=SplitConfig)
    store: StoreConfig = field(default_factory=StoreConfig)


def get_config() -> Config:
    """Settings from the environment as it is now."""
    return Config()


def parse_dotenv(text: str) -> dict[str, str]:
    """Variables of a .env file's text: NAME=value, a value in quotes without them; lines that are none are skipped."""
    out = {}
    for line in text.splitlines():
        name, equals, value = line.strip().partition("=")
        if not equals or name.startswith("#"):
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[name.strip()] = value
    return out


def load_dotenv(path: str) -> None:
    """Set variables of a .env file that are not set yet."""
    for name, value in parse_dotenv(Path(path).read_text()).items() if Path(path).exists() else ():
        os.environ.setdefault(name, value)


def health() -> dict[str, str]:
    return {"status": "healthy", "version": __version__}
