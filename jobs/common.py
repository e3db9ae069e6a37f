"""What the jobs share: sessions for the command line, config files, log lines."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields
from typing import Any, TypeVar

from pyspark.sql import SparkSession

from sigtok.errors import SigtokError
from sigtok.session import DEFAULTS, ship

LOG = logging.getLogger("sigtok.jobs")
T = TypeVar("T")


def config_of(kind: type[T], path: str | None) -> T:
    """The config in a JSON file on the driver's machine; the defaults without one. Unknown keys are errors."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8") as f:
        given: Any = json.load(f)
    known = {f.name: f for f in fields(kind)}
    if not isinstance(given, dict) or not set(given) <= set(known):
        raise SigtokError(f"the config {path} may have the keys {sorted(known)} and no others")
    for name, value in given.items():
        if type(value).__name__ != known[name].type:
            raise SigtokError(f"{name} in the config {path} has to be of type {known[name].type}")
    return kind(**given)


def parser(about: str, *paths: tuple[str, str]) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=about)
    for name, text in paths:
        p.add_argument(name, help=text)
    p.add_argument("--config", help="a JSON file; without it, the job's defaults")
    return p


def session(name: str) -> SparkSession:
    """The submitted session, or a local one."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return ship(SparkSession.builder.appName(name).config(map=DEFAULTS).getOrCreate())
