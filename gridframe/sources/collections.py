"""Collections of containers: found by patterns, told apart by tags, read in one scan and matched by key or in turn.

A collection is a dataset of many containers as one DataFrame with a ``tag`` column; Spark reads all
files of it in one job, and whoever looks for the container of a key joins on the tag.
"""

from __future__ import annotations

import re
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.sources import folders
from gridframe.sources.reader import part_of


def stem(path: str) -> str:
    """A path's last name without its extension."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name


def groups_of_files(spark: SparkSession, groups: list[dict[str, Any]]) -> list[tuple[str, list[str]]]:
    """(tag, paths) of groups given by patterns as ``files``; a group without a tag is called group_<place>.

    Tags are told once each, and a path that isn't there is an error."""
    out = [(g.get("tag", f"group_{i}"), folders.find(spark, g["files"])) for i, g in enumerate(groups)]
    if len({t for t, _ in out}) < len(out):
        raise ValueError("two groups have the same tag")
    return out


def paths_and_tags(templates: list[str], tags: list[str]) -> list[tuple[str, str]]:
    """(path, tag): every template with every tag put in for ``{tag}``, all tags of a template together."""
    return [(t.format(tag=tag), tag) for t, tag in product(templates, tags)]


def path_from_attributes(template: str, attrs: dict[str, Any]) -> str:
    """A path with attributes of another container put in; one that isn't there is an error that names it."""
    try:
        return template.format(**attrs)
    except KeyError as e:
        raise ValueError(f"{template} needs the attribute {e.args[0]!r}") from e


def collection(spark: SparkSession, paths: list[str] | list[tuple[str, str]], dataset: str) -> DataFrame:
    """One dataset of many containers, with ``tag``: the name given with the path, else the path's stem.

    All are read in one scan, with the schema of the first; each row's tag is found from its own file."""
    named = [p if isinstance(p, tuple) else (p, stem(p)) for p in paths]
    if not named:
        raise ValueError("no paths")
    known: dict[str, str] = {}
    for path, tag in named:
        fs, at = folders.hadoop(spark, path)
        known[re.sub("^([a-z0-9]+):/+", r"\1:/", fs.makeQualified(at).toUri().toString())] = tag
    if len(set(known.values())) < len(named):
        raise ValueError("two containers have the same tag")
    rows = spark.read.parquet(*[f"{p}/data/{dataset}" for p, _ in named])
    tags = spark.createDataFrame(list(known.items()), "_part string, tag string")  # one short row a container
    return rows.withColumn("_part", part_of()).join(F.broadcast(tags), "_part").drop("_part")


def in_order(spark: SparkSession, paths: list[str] | list[tuple[str, str]]) -> DataFrame:
    """(place, tag) of a collection."""
    return spark.createDataFrame([(i, p[1] if isinstance(p, tuple) else stem(p)) for i, p in enumerate(paths)], "place long, tag string")


def matched(wants: DataFrame, held: DataFrame, key: Column, axes: list[str] = (), missing: str = "drop") -> DataFrame:
    """Rows beside those of the container whose tag is their key (and, with ``axes``, on the same positions).

    Rows that have no container are dropped, kept with nulls ("keep"), or stop the job ("fail")."""
    if missing not in ("drop", "keep", "fail"):
        raise ValueError("rows without a container are dropped, kept or an error")
    keyed = wants.withColumn("tag", key)
    if missing == "drop":
        return keyed.join(held, ["tag", *axes])
    both = keyed.join(held.withColumn("_held", F.lit(True)), ["tag", *axes], "left")
    if missing == "fail":
        both = both.where(F.when(F.col("_held").isNull(), F.raise_error(F.concat(F.lit("no container is tagged "), F.coalesce("tag", F.lit("null"))))).otherwise(F.lit(True)))
    return both.drop("_held")


def in_turn(wants: DataFrame, position: str, held: DataFrame, order: DataFrame, axes: list[str] = ()) -> DataFrame:
    """Rows beside those of the containers of a collection in turn: position modulo their number, in ``order``."""
    n = order.count()
    turn = order.select((F.col("place")).alias("_turn"), "tag")
    return wants.withColumn("_turn", F.pmod(F.col(position), F.lit(n))).join(F.broadcast(turn), "_turn").drop("_turn").join(held, ["tag", *axes])
