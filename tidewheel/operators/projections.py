"""Row-wise changes of structure, planned on the driver from the schema and run as one projection."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all fields that are no structs, in order."""
    out: list[tuple[str, ...]] = []
    for f in schema:
        path = (*prefix, f.name)
        out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [path]
    return out


def at(path: Sequence[str]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to columns named by their paths, a/b/c."""
    return df.select(*(at(p).alias("/".join(p)) for p in leaves(df.schema)))


def _build(tree: Mapping, get: Callable[[str], Column]) -> list[Column]:
    return [(F.struct(*_build(v, get)) if isinstance(v, Mapping) else get(v)).alias(k) for k, v in tree.items()]


def unflatten(df: DataFrame) -> DataFrame:
    """The inverse of flatten."""
    return df.select(*_build(nest({c: c for c in df.columns}), lambda c: F.col(f"`{c}`")))


def nest(flat: Mapping[str, str]) -> dict:
    tree: dict = {}
    for path, value in flat.items():
        *parents, last = path.split("/")
        node = tree
        for p in parents:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path} lies below a value")
        if last in node:
            raise ValueError(f"{path} is there twice")
        node[last] = value
    return tree


def repack(df: DataFrame, structure: Mapping) -> DataFrame:
    """A new record from paths of the old one; a path that isn't there raises ValueError."""
    known = {"/".join(p): p for p in leaves(df.schema)}

    def get(path: str) -> Column:
        if path not in known:
            raise ValueError(f"no field {path}")
        return at(known[path])

    return df.select(*_build(structure, get))


def rename(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Paths renamed, or dropped where the replacement is None, by the first pattern that matches all of a path; two of one name raise ValueError."""
    new: dict[str, str] = {}
    for path in ("/".join(p) for p in leaves(df.schema)):
        name: str | None = path
        for pattern, replacement in patterns.items():
            if m := re.fullmatch(pattern, path):
                name = None if replacement is None else m.expand(replacement)
                break
        if name is not None:
            if name in new:
                raise ValueError(f"{path} and {new[name]} would both be {name}")
            new[name] = path
    return df.select(*_build(nest(new), lambda p: at(p.split("/"))))


def apply_tree(df: DataFrame, selected: Sequence[str], change: Callable[[Column], Column], strict: bool = False) -> DataFrame:
    """A function on the fields at the selected paths; strict: all of them must be there."""
    paths = ["/".join(p) for p in leaves(df.schema)]
    if strict and (missing := set(selected) - set(paths)):
        raise ValueError(f"no field {', '.join(sorted(missing))}")
    chosen = set(selected)
    return df.select(*_build(nest({p: p for p in paths}), lambda p: change(at(p.split("/"))) if p in chosen else at(p.split("/"))))


def with_default(df: DataFrame, name: str, value: object) -> DataFrame:
    """A literal column where there is none of that name; nulls of one that is there stay."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def without_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.StringType)))


def observation(df: DataFrame, fields: Mapping[str, Column], cameras: Sequence[str], prompt: Column | None = None) -> DataFrame:
    """Add the struct `observation`: the fields, a true mask per camera, and the prompt if there is one."""
    mask = F.struct(*(F.lit(True).alias(c) for c in cameras)).alias("image_mask")
    extra = [] if prompt is None else [prompt.alias("prompt")]
    return df.withColumn("observation", F.struct(*(v.alias(k) for k, v in fields.items()), mask, *extra))


def first_match(rules: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def checked(value: Column, condition: Column, message: str) -> Column:
    """value, or an error of the whole query where the condition doesn't hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def paired(a: str, b: str) -> Column:
    """Whether two columns are both null or both not."""
    return F.col(f"`{a}`").isNull() == F.col(f"`{b}`").isNull()


def is_rgb(image: str) -> Column:
    """Whether a struct of data, h, w, c holds whole rows of three bytes per pixel."""
    i = F.col(f"`{image}`")
    return F.coalesce((i["c"] == 3) & (i["h"] > 0) & (i["w"] > 0) & (F.length(i["data"]) == i["h"] * i["w"] * i["c"]), F.lit(False))


def concatenated(datasets: Sequence[DataFrame], transforms: Sequence[Callable[[DataFrame], DataFrame] | None] | None = None) -> DataFrame:
    """Datasets one after another with dataset_idx, each through the transform in its place; None leaves one as it is."""
    given = list(transforms) if transforms is not None else [None] * len(datasets)
    if not datasets or len(given) != len(datasets):
        raise ValueError(f"{len(datasets)} datasets and {len(given)} transforms")
    parts = [(d if t is None else d.transform(t)).withColumn("dataset_idx", F.lit(i)) for i, (d, t) in enumerate(zip(datasets, given, strict=True))]
    return functools.reduce(DataFrame.unionByName, parts)
