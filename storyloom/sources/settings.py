"""Settings from YAML or JSON files and the environment, read on the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from storyloom import schemas
from storyloom.operators.normalize import with_defaults
from storyloom.operators.stories import Label

GROUPS = {"macro_themes": "themes", "institutions": "institutions", "sectors": "sectors", "companies": "companies", "indices": "indices"}


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith(".json"):
        return json.loads(raw)
    import yaml

    return yaml.safe_load(raw)


def sources(spark: SparkSession, settings: dict) -> DataFrame:
    """The sources with the defaults merged in and their order (source_ord)."""
    names = [c.split()[0] for c in schemas.SOURCE.split(", ")]
    rows = [(*(s.get(n) for n in names), k) for k, s in enumerate(settings["sources"])]
    return with_defaults(spark.createDataFrame(rows, schemas.SOURCE + ", source_ord int"), settings.get("defaults", {}))


def watchlist(settings: dict) -> tuple[list[Label], list[str], list[str]]:
    """Labels with their aliases, patterns of excluded titles, and noise phrases."""
    labels = [
        Label(group, x["label"], x.get("aliases", []), x.get("weight"), x.get("ticker")) for key, group in GROUPS.items() for x in settings.get(key, [])
    ]
    return labels, settings.get("hard_exclude_patterns", []), settings.get("noise_patterns", [])


def weights(labels: list[Label], default: float = 4.0) -> dict[str, float]:
    """Weights that scores look up; companies have none there, whatever they say."""
    return {x.label: float(default if x.weight is None else x.weight) for x in labels if x.group != "companies"}


def rules(settings: dict) -> tuple[tuple, tuple]:
    """(severity, pattern, rule) triples and attribution markers."""
    found = [("blocking", p["pattern"], p["rule"]) for p in settings.get("blocking_patterns", [])]
    found += [("minor", p["pattern"], p["rule"]) for p in settings.get("minor_patterns", [])]
    return tuple(found), tuple(settings.get("attribution_markers", []))


def prompt(folder: str, name: str) -> str:
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        return f.read()


def dotenv(path: str, environment: dict | None = None) -> None:
    """KEY=value lines into the environment; what is set there already wins."""
    environment = os.environ if environment is None else environment
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if eq and key and not key.startswith("#"):
                environment.setdefault(key.strip(), value.strip())


def words(path: str) -> tuple[str, ...]:
    """The words of a text file, lower-cased, each once; none if there is no file."""
    if not os.path.exists(path):
        return ()
    with open(path, encoding="utf-8") as f:
        return tuple(dict.fromkeys(f.read().lower().split()))
