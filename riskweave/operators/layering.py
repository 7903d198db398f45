"""Layering of macro panels onto loans (left outer join by country and year).

A loan meets the macro rows of its country code (spaces around it do not
count) and of its year as a whole number, whatever their frequency, as long
as one is stated. Several such rows fan the loan out; ``assert_unique``
turns that into an error instead.

The join is a plain equi-join: the optimizer broadcasts the macro side if
its size in bytes is below the session's threshold, else both sides are
shuffled and adaptive execution splits the partitions of large countries.
Loans whose key is NULL match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.schema import MACRO_EXCLUDE
from riskweave.sources.macro import read_macro

_K_CODE, _K_YEAR = "__layer_code", "__layer_year"


@dataclass(frozen=True)
class LayerSpec:
    """A named macro layer: how to load it and which columns stay behind."""
    name: str
    load: Callable[[SparkSession], DataFrame]
    exclude: tuple[str, ...] = field(default=MACRO_EXCLUDE)


def _fresh_name(name: str, taken: set[str]) -> str:
    """A colliding column gets the first free suffix _1, _2, ..."""
    if name not in taken:
        return name
    i = 1
    while f"{name}_{i}" in taken:
        i += 1
    return f"{name}_{i}"


def macro_keys(macro: DataFrame, exclude: Sequence[str] = MACRO_EXCLUDE) -> tuple[DataFrame, list[str]]:
    """Macro side with the join keys computed once; rows with a NULL
    frequency are dropped because they can never match."""
    carried = [c for c in macro.columns if c not in exclude]
    keyed = (macro.where(F.col("frequency").isNotNull())
             .select(F.trim("country_code").alias(_K_CODE),
                     F.col("year").cast("int").alias(_K_YEAR),
                     *carried))
    return keyed, carried


def layer_macro(loans: DataFrame, macro: DataFrame, exclude: Sequence[str] = MACRO_EXCLUDE,
                assert_unique: bool = False) -> DataFrame:
    """``loans.*`` plus the macro columns not in ``exclude``, left outer join."""
    m, carried = macro_keys(macro, exclude)
    if assert_unique:
        dup = m.groupBy(_K_CODE, _K_YEAR).count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError("macro layer has several rows for one (country_code, year)")
    taken = set(loans.columns)
    out_names = []
    for c in carried:
        n = _fresh_name(c, taken)
        taken.add(n)
        out_names.append(n)
    m = m.toDF(_K_CODE, _K_YEAR, *out_names)

    code, whole = F.trim(loans["country_code"]), loans["year"].cast("int")
    joined = loans.join(m, (code == m[_K_CODE]) & (whole == m[_K_YEAR]), "left")
    return joined.select(*[loans[c] for c in loans.columns], *[m[c] for c in out_names])


def folder_catalogue(spark: SparkSession, folder: str) -> dict[str, LayerSpec]:
    """The macro panels of a folder by name: CSV files (``name.csv``), Parquet
    folders and replaceable tables. Hidden entries are left out; a folder
    that is not there has none. Nothing is read before a layer is used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    out = {}
    for entry in fs.listStatus(path):
        name, where = entry.getPath().getName(), entry.getPath().toString()
        if name.startswith((".", "_")) or not (entry.isDirectory() or name.endswith(".csv")):
            continue
        fmt = "csv" if name.endswith(".csv") else "parquet"
        out[name.removesuffix(".csv")] = LayerSpec(name.removesuffix(".csv"), lambda s, w=where, f=fmt: read_macro(s, w, f))
    return dict(sorted(out.items()))


def apply_layers(loans: DataFrame, layers: Sequence[str | DataFrame | LayerSpec],
                 spark: SparkSession | None = None, catalogue: Mapping[str, LayerSpec] | None = None, **kwargs) -> DataFrame:
    """Fold the selected layers over the loans; no layer -> loans unchanged.

    A name is looked up in ``catalogue``; an unknown one raises before any
    layer is applied."""
    catalogue = catalogue or {}
    unknown = [x for x in layers if isinstance(x, str) and x not in catalogue]
    if unknown:
        raise ValueError(f"unknown layers {unknown}; choose from {sorted(catalogue)}")
    out = loans
    for layer in layers:
        if isinstance(layer, str):
            layer = catalogue[layer]
        if isinstance(layer, LayerSpec):
            out = layer_macro(out, layer.load(spark or loans.sparkSession), layer.exclude, **kwargs)
        else:
            out = layer_macro(out, layer, **kwargs)
    return out
