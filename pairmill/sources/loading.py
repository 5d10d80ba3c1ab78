"""Data sets by name: which splits there are, files by configuration, slices of splits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.sources.datasource import _listed

#: Formats by the end of a file's name.
FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "arrow": "arrow_folder"}
_SLICE = re.compile(r"^\s*(\w+)\s*(?:\[\s*(-?\d*)(%?)\s*:\s*(-?\d*)(%?)\s*\])?\s*$")


@dataclass(frozen=True)
class Loader:
    """A named data set: its folder, its configurations, and the splits of each (of a configuration not named here: found)."""

    name: str
    path: str
    schema: str
    format: str = "parquet"
    splits: dict[str, tuple[str, ...]] = field(default_factory=dict)
    order: str | None = None

    def place(self, config: str | None, split: str) -> str:
        return "/".join(x for x in (self.path, config, split) if x)


def available(loader: Loader, config: str | None = None) -> list[str]:
    """Splits that a configuration has."""
    said = loader.splits.get(config or "", ())
    there = [f.base_name for f in _listed(loader.place(config, "")) if not f.is_file]
    return sorted(s for s in there if not s.startswith(("_", ".")) and (not said or s in said))


def configs(loader: Loader) -> list[str]:
    """Configurations: the folders that a data set's folder has."""
    return sorted(f.base_name for f in _listed(loader.path) if not f.is_file and not f.base_name.startswith(("_", ".")))


def _read(spark: SparkSession, loader: Loader, places: list[str]) -> DataFrame:
    reader = spark.read.schema(loader.schema)
    if loader.format in ("csv", "tsv"):
        return reader.csv(places, header=True, sep="\t" if loader.format == "tsv" else ",", multiLine=True, escape='"')
    return reader.format(FORMATS[loader.format]).load(places)


def _at(text: str, percent: str, n, empty: int):
    """A bound of a slice as a row's number; negative ones count from the end."""
    if not text:
        return F.lit(None) if empty else F.lit(0)
    k = int(text)
    at = F.round(n * (k / 100)) if percent else F.lit(k)
    return F.greatest(F.lit(0), n + at) if k < 0 else at


def load(spark: SparkSession, loader: Loader, split: str = "train", config: str | None = None, data_files: list[str] | None = None) -> DataFrame:
    """Rows of splits with their split: ``train``, ``train+test``, ``train[:100]``, ``train[10%:-5]``.

    A slice needs the loader's order; its rows' places come from an exact rank,
    not from one sorted run. data_files names files of the configuration's
    folder instead of split folders. A split that isn't there is an error.
    """
    have, out = available(loader, config), None
    for part in split.split("+"):
        m = _SLICE.match(part)
        if not m:
            raise ValueError(f"{part} is no split")
        name, lo, lo_p, hi, hi_p = m.groups()
        if not data_files and name not in have:
            raise ValueError(f"{loader.name} has the splits {', '.join(have) or '(none)'}, not {name}")
        rows = _read(spark, loader, [f"{loader.place(config, '')}/{f}" for f in data_files] if data_files else [loader.place(config, name)])
        if lo or hi:
            if not loader.order:
                raise ValueError("a slice needs an order")
            rows = _sliced(rows, loader.order, lo, lo_p or "", hi, hi_p or "")
        rows = rows.withColumn("split", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def _sliced(rows: DataFrame, order: str, lo: str, lo_p: str, hi: str, hi_p: str) -> DataFrame:
    """Rows from one place to another in the order of a column that tells them apart.

    A slice from the start by a number needs a bounded sort alone. For others
    the column's ranges are counted first.
    """
    if not lo and hi and not hi_p and not hi.startswith("-"):
        return rows.orderBy(order).limit(int(hi))
    from pairmill.sources.writers import dense_ids

    placed = dense_ids(rows, order, "", "place__").withColumn("place__", F.col("place__").cast("long"))
    n = F.lit(rows.count())
    start, stop = _at(lo, lo_p, n, 0), _at(hi, hi_p, n, 1)
    return placed.where((F.col("place__") >= start) & (stop.isNull() | (F.col("place__") < stop))).drop("place__")


def load_all(spark: SparkSession, loader: Loader, split: str = "train") -> DataFrame:
    """Every configuration that has the split, with its name in config."""
    out = None
    for c in configs(loader):
        if split in available(loader, c):
            rows = load(spark, loader, split, c).withColumn("config", F.lit(c))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no configuration of {loader.name} has {split}")
    return out


