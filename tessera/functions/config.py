"""Configurations: one file as a dictionary, for the driver; any number of documents as rows of settings, for Spark."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIXES = (".yaml", ".yml", ".json", ".toml")


def load(folder: str, name: str) -> dict[str, Any]:
    """The configuration `name` of a folder: name.yaml, .yml, .json or .toml, or a full file name. An absent one is an error."""
    for path in [Path(folder) / name] if Path(name).suffix else [Path(folder) / f"{name}{x}" for x in SUFFIXES]:
        if path.exists():
            return parsed(path.read_text(encoding="utf-8"), path.suffix)
    raise FileNotFoundError(f"no configuration {name} in {folder}")


def parsed(text: str, suffix: str) -> dict[str, Any]:
    """The settings in the text of a file with that suffix; an empty YAML file has none."""
    if suffix == ".json":
        return json.loads(text)
    if suffix == ".toml":
        import tomllib

        return tomllib.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ValueError("YAML needs a parser that is not installed; use JSON or TOML") from error
    return yaml.safe_load(text) or {}


def settings_rows(documents: DataFrame, depth: int = 16) -> DataFrame:
    """config, key, value of documents (config, body: JSON text): a row for each setting, its key dotted, its value as text.

    One pass without a shuffle: objects are opened level by level as variants, so that documents may differ in their fields. Texts come as they are, numbers and booleans as
    JSON writes them, a null as null; a list is one setting, as JSON. An empty object has no settings, nor has a null body; a body that is no object is one setting with the key ''.
    Broken JSON, and objects inside more than `depth` others, are errors. Equal documents each give their rows.
    """
    rows = documents.select("config", F.lit("").alias("key"), F.parse_json("body").alias("v")).where("v IS NOT NULL")
    inner = F.try_variant_get("v", "$", "map<string,variant>")  # null if it is no object
    for _ in range(depth):
        key = lambda e: F.when(F.col("key") == "", e["key"]).otherwise(F.concat("key", F.lit("."), e["key"]))
        opened = F.transform(F.map_entries(inner), lambda e: F.struct(key(e).alias("key"), e["value"].alias("v")))
        rows = rows.select("config", F.inline(F.coalesce(opened, F.array(F.struct("key", "v")))))
    text = F.coalesce(F.try_variant_get("v", "$", "string"), F.when(~F.is_variant_null("v"), F.to_json("v")))
    deep = F.raise_error(F.concat(F.lit("too many objects inside each other at "), F.col("key")))
    return rows.select("config", "key", F.when(F.size(inner) > 0, deep).otherwise(text).alias("value"))


def flatten(config: dict[str, Any]) -> list[tuple[str, str]]:
    """(dotted key, value as text) of nested settings, in order."""
    found, open_ = [], [iter(((key,), value) for key, value in config.items())]
    while open_:
        path, value = next(open_[-1], (None, None))
        if path is None:
            open_.pop()
        elif isinstance(value, dict):
            open_.append(iter([((*path, key), inner) for key, inner in value.items()]))
        else:
            found.append((".".join(path), str(value)))
    return found


def settings_table(spark, configs: dict[str, dict[str, Any]]):
    """DataFrame (config, place, key, value) of all settings, in order of place."""
    rows = [(name, i, key, value) for name, config in configs.items() for i, (key, value) in enumerate(flatten(config))]
    return spark.createDataFrame(rows, "config string, place long, key string, value string")


def snapshot(configs: dict[str, dict[str, Any]], title: str, heading: str = "== {} ==", line: str = "{} = {}") -> str:
    """A block of text with all settings: a heading, and for each configuration its name as a heading and a line for each setting."""
    parts = [heading.format(title)]
    for name, config in configs.items():
        parts += [heading.format(name), *(line.format(*setting) for setting in flatten(config))]
    return "\n".join(parts) + "\n"
