"""What a run of the engine depends on besides its tables; there is no hidden clock."""

from __future__ import annotations

import dataclasses
import datetime as dt
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """``as_of`` is the last snapshot day; ``run_at`` stamps what is generated; ``run_id`` names the run."""

    as_of: dt.date
    k: int = 5
    run_id: str | None = None
    run_at: dt.datetime | None = None
    policy_version: str = "k-anonymity-v1"

    @property
    def stamp(self) -> dt.datetime:
        return self.run_at or dt.datetime.combine(self.as_of, dt.time())


#: The as-of date of the queries over the driver's tables.
DEFAULT = EngineConfig(as_of=dt.date(2001, 12, 31))


@dataclass(frozen=True)
class Settings:
    """Where marts are found, and what a run is configured with."""

    database: str = "people_analytics"
    engine: EngineConfig = DEFAULT


#: Setting -> what reads its text.
_SETTINGS = {"as_of": dt.date.fromisoformat, "k": int, "run_id": str, "run_at": dt.datetime.fromisoformat, "policy_version": str, "database": str}


def settings(environ: Mapping[str, str] = os.environ, file: str | None = None) -> Settings:
    """Settings from the variables ``KINROSTER_<NAME>``, else from a TOML file of the same names, else the defaults.

    The file is ``file`` or that named by ``KINROSTER_CONFIG``. An empty variable counts as not set; an
    unknown name in the file, or a value that cannot be read, is an error.
    """
    file = file or environ.get("KINROSTER_CONFIG") or None
    given: dict[str, str] = {}
    if file:
        with open(file, "rb") as f:
            given = {name: str(value) for name, value in tomllib.load(f).items()}
    if unknown := given.keys() - _SETTINGS.keys():
        raise ValueError(f"no such setting: {sorted(unknown)}")
    given |= {name: environ[f"KINROSTER_{name.upper()}"] for name in _SETTINGS if environ.get(f"KINROSTER_{name.upper()}")}
    read = {name: _SETTINGS[name](text) for name, text in given.items()}
    database = read.pop("database", Settings.database)
    return Settings(database, dataclasses.replace(DEFAULT, **read))
