"""Registries of metrics and language readers, policies from settings, and profiles."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a metric gives: a row for each measurement.
MEASUREMENT = ["path", "line", "column", "component", "definition", "subject", "value"]


class Metrics:
    """Builders of measurements by component.  A builder gets the tables of facts by name and gives a
    DataFrame of ``MEASUREMENT`` columns without component and definition."""

    def __init__(self) -> None:
        self.builders: dict[str, tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = {}

    def add(self, component: str, definition: str):
        """A decorator; a component can be added once."""
        if component in self.builders:
            raise ValueError(f"{component} is there already")

        def keep(build):
            self.builders[component] = (definition, build)
            return build

        return keep

    def analyze(self, facts: dict[str, DataFrame], requested: list[str] | None = None) -> DataFrame:
        """Measurements of the ``requested`` components (all, if None) in the order of path, line, column and
        component; what isn't requested isn't built."""
        names = sorted(self.builders) if requested is None else sorted(set(requested))
        unknown = [n for n in names if n not in self.builders]
        if unknown or not names:
            raise ValueError(f"no metric {', '.join(unknown)}" if unknown else "no metric requested")
        parts = []
        for name in names:
            definition, build = self.builders[name]
            rows = build(facts).withColumns({"component": F.lit(name), "definition": F.lit(definition), "value": F.col("value").cast("double")})
            parts.append(rows.select(*MEASUREMENT))
        return reduce(DataFrame.unionByName, parts).orderBy("path", "line", "column", "component")


class Readers:
    """Readers of sources by language: functions from ``files(path, content)`` to a table of facts."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, language: str, read: Callable[[DataFrame], DataFrame]) -> None:
        if language in self.readers:
            raise ValueError(f"{language} is there already")
        self.readers[language] = read

    def read(self, files: DataFrame, languages: list[str]) -> DataFrame:
        """The facts of ``files(path, content, language)`` of all ``languages``, which must have a reader."""
        missing = [x for x in languages if x not in self.readers]
        if missing or not languages:
            raise ValueError(f"no reader of {', '.join(missing) or 'nothing'}")
        return reduce(DataFrame.unionByName, [self.readers[x](files.where(F.col("language") == x).drop("language")) for x in languages])


def policy(spark: SparkSession, settings: dict, components: list[str]) -> DataFrame:
    """(component, weight, enabled) of ``settings`` (component: {weight, enabled}); what is left out is null.  Names
    that aren't among ``components`` and weights that aren't finite and at least zero are errors."""
    rows = []
    for name, setting in sorted(settings.items()):
        if name not in components:
            raise ValueError(f"no component {name}")
        if set(setting) - {"weight", "enabled"}:
            raise ValueError(f"{name}: only weight and enabled can be set")
        weight = setting.get("weight")
        if weight is not None and not (math.isfinite(weight) and weight >= 0):
            raise ValueError(f"{name}: a weight is finite and at least zero")
        rows.append((name, None if weight is None else float(weight), setting.get("enabled")))
    return spark.createDataFrame(rows, "component string, weight double, enabled boolean")


# Names that a calibration profile must have, all positive numbers.
PROFILE = ("operation", "accessor", "input", "alias", "field", "sequence", "free", "reference", "responsibility")


def profile_identity(profile: dict[str, float]) -> str:
    """SHA-256 that names a calibration profile; one with other names than ``PROFILE`` or with a value that isn't a
    positive number is an error."""
    if set(profile) != set(PROFILE):
        raise ValueError(f"a profile has {', '.join(PROFILE)}")
    for name, value in profile.items():
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or value <= 0:
            raise ValueError(f"{name} must be a positive number")
    return hashlib.sha256(json.dumps({k: float(v) for k, v in profile.items()}, sort_keys=True).encode()).hexdigest()
