"""Collecting a sample: filter, split, draw, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievecraft.operators import classes, copies, sampling
from sievecraft.sources import catalog as catalog_source
from sievecraft.sources import sample_store
from sievecraft.sources.schema import CATALOG_FIELDS
from sievecraft.spec import CollectionSpec


def candidates(
    catalog: DataFrame, spec: CollectionSpec, mode: str = "collect", on_bad_date: str | None = None
) -> DataFrame:
    return classes.by_class(classes.base(catalog, spec, mode, on_bad_date), spec)


def collect_sample(
    catalog: DataFrame,
    spec: CollectionSpec,
    mode: str = "collect",
    on_bad_date: str | None = None,
    keys_unique: bool = False,
    one_per_key: bool = False,
) -> DataFrame:
    """Both classes' samples in one table: ``class, sample_rank``, then the catalogue's columns.

    Without a seed in the spec each call draws another sample; use ``spec.with_seed()`` to keep one. ``one_per_key`` leaves
    one row of each key, the one of least content hash, among those the command considers.
    """
    spec = spec.with_seed()
    if one_per_key:
        base = classes.base(catalog, spec, mode, on_bad_date)
        rows = classes.by_class(copies.one_per_key(base, "sha256", [c for c in CATALOG_FIELDS if c in base.columns]), spec)
        return sampling.draw(rows, spec.wanted, spec.random_seed, keys_unique=True)
    rows = candidates(catalog, spec, mode, on_bad_date)
    return sampling.draw(rows, spec.wanted, spec.random_seed, keys_unique=keys_unique)


def stored_sample(
    spark: SparkSession,
    table_dir: str,
    store: str,
    spec: CollectionSpec,
    mode: str = "collect",
    on_bad_date: str | None = None,
    keys_unique: bool = False,
    force: bool = False,
    one_per_key: bool = False,
) -> DataFrame:
    """The sample of a typed table by way of the store: read back if it is there, else drawn and kept.

    ``force`` draws anew. An unseeded spec gets a seed of its own in each call; the sample is kept under that seed, and
    ``sample_store.drawn_seeds`` lists what was drawn.
    """

    def draw() -> DataFrame:
        table = catalog_source.read_table(spark, table_dir)
        return collect_sample(table, spec, mode, on_bad_date, keys_unique, one_per_key)

    spec = spec.with_seed()
    key = spec.fingerprint(catalog_source.catalog_id(spark, table_dir), mode, on_bad_date, keys_unique, one_per_key)
    return sample_store.stored_or_drawn(spark, store, spec, key, draw, force)
