"""Feature store: routes, extracts, caches and assembles features."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.operators.splits import sort_by_key
from feedlens.plans.extractors import DEFAULT
from feedlens.plans.registry import Extractor, Registry
from feedlens.sources.paths import clear_directory, is_complete, subdirectories
from feedlens.sources.writers import write_auxiliaries, write_feature


@dataclass(frozen=True)
class FeatureCache:
    """Parquet cache below ``root``, keyed by dataset, extractor and version.

    ``dataset`` identifies the input, for instance by
    :func:`feedlens.sources.paths.dataset_fingerprint`; two datasets with the
    same number of rows never share an entry. What else a feature was computed
    from, auxiliaries and earlier features, is part of its name.
    """

    root: str
    dataset: str

    def path(self, extractor: Extractor, sources: list[str] = ()) -> str:
        name = extractor.cache_name
        if sources:
            name += "-" + hashlib.sha256("\n".join(sources).encode()).hexdigest()[:16]
        return f"{self.root}/{self.dataset}/{name}"

    def clear(self, spark: SparkSession) -> None:
        clear_directory(spark, f"{self.root}/{self.dataset}")


def concat_features(frames: list[DataFrame]) -> DataFrame:
    """Inner join of keyed feature tables on the row key."""
    return reduce(lambda left, right: left.join(right, S.KEYS, "inner"), frames)


def row_contract(raw: DataFrame, feature: DataFrame) -> DataFrame:
    """One row: does a keyed feature table have exactly one row per raw row?"""
    return contract_report(raw, feature).drop("missing_keys", "foreign_keys")


def contract_report(raw: DataFrame, feature: DataFrame) -> DataFrame:
    """The row contract, and which side has keys that the other one lacks.

    ``surplus_rows`` repeat a key of the feature, ``missing_keys`` are raw keys
    without a feature, ``foreign_keys`` are no raw keys. A key with a null matches
    nothing in a join, so it is missing or foreign on its side.
    """
    whole = reduce(and_, [F.col(k).isNotNull() for k in S.KEYS])
    sides = [df.select(*S.KEYS, F.lit(of_raw).alias("r"), F.lit(1 - of_raw).alias("f")) for df, of_raw in ((raw, 1), (feature, 0))]
    per_key = sides[0].unionByName(sides[1]).groupBy(*S.KEYS).agg(F.sum("r").alias("r"), F.sum("f").alias("f"))
    n, r, f = F.lit(0).cast("long"), F.col("r"), F.col("f")
    return per_key.agg(
        F.coalesce(F.sum(r), n).alias("raw_rows"),
        F.coalesce(F.sum(f), n).alias("feature_rows"),
        F.coalesce(F.sum(F.greatest(f - 1, n)), n).alias("surplus_rows"),
        F.count_if((r > 0) & ((f == 0) | ~whole)).alias("missing_keys"),
        F.count_if((f > 0) & ((r == 0) | ~whole)).alias("foreign_keys"),
        F.coalesce(F.bool_and((r == 1) & (f == 1) & whole), F.lit(True)).alias("holds"),
    )


def key_print(df: DataFrame) -> Row:
    """Fingerprint of the row keys of a table as a multiset: their number, how
    many have a null, and the sums of both halves of their 64-bit hashes. One pass,
    no shuffle of rows, any order."""
    code = F.xxhash64(*S.KEYS)
    nulls = reduce(or_, [F.col(k).isNull() for k in S.KEYS])
    halves = F.shiftrightunsigned(code, 32), code.bitwiseAND(0xFFFFFFFF)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(nulls).alias("nulls"), *[F.sum(h).alias(f"sum{i}") for i, h in enumerate(halves)]).first()


class FeatureStore:
    """Assembles the model-ready table of one dataset.

    ``enabled`` names raw columns and registered extractors, in the order the
    extractors run. Features given as column expressions become part of one
    projection over the raw table. A feature given as the table so far with more
    columns replaces that table. Only features given as keyed tables are joined
    by row key. By default only those are cached, because joining a stored
    feature back costs two shuffles of all rows, mostly more than computing it
    again; ``cache_all`` stores every feature and reads it back.

    Every feature table must have exactly one row per raw row, under the raw keys.
    That is verified by fingerprints of both key sets, one pass a side, and once
    per store that no raw key repeats; ``check_contract=False`` leaves it out.
    Expressions cannot break the contract and are not checked.
    """

    def __init__(
        self,
        raw: DataFrame,
        enabled: list[str],
        auxiliaries: list[str] = (),
        registry: Registry = DEFAULT,
        feature_cache: FeatureCache | None = None,
        auxiliary_cache: FeatureCache | None = None,
        inference: bool = False,
        cache_all: bool = False,
        check_contract: bool = True,
    ):
        self.raw = raw
        self.registry = registry
        self.feature_cache = feature_cache
        self.auxiliary_cache = auxiliary_cache
        self.inference = inference
        self.cache_all = cache_all
        self.check_contract = check_contract
        names = list(dict.fromkeys(enabled))
        self.default = [n for n in names if n in raw.columns]
        self.custom = [n for n in names if n not in raw.columns]
        self.auxiliary_names = list(dict.fromkeys(auxiliaries))
        unknown = [n for n in self.custom if n not in registry.features]
        unknown += [n for n in self.auxiliary_names if n not in registry.auxiliaries]
        if unknown:
            raise KeyError(f"neither a raw column nor a registered extractor: {unknown}")

    def auxiliaries(self) -> dict[str, DataFrame]:
        """Auxiliary tables by key, read from the cache where stored.

        At inference, stored tables (those of the training data) are handed to
        the extractor to be extended by the new data; the result is not stored.
        """
        spark, tables = self.raw.sparkSession, {}
        for name in self.auxiliary_names:
            extractor = self.registry.auxiliaries[name]
            path = self.auxiliary_cache.path(extractor) if self.auxiliary_cache else None
            keys = subdirectories(spark, path) if path else []
            if keys and all(is_complete(spark, f"{path}/{key}") for key in keys):
                stored = {key: spark.read.parquet(f"{path}/{key}") for key in keys}
                tables.update(stored)
                if self.inference:
                    tables.update(_tables(name, extractor.function(self.raw, auxiliary_train=stored)))
                continue
            extracted = _tables(name, extractor.function(self.raw))
            if path:
                write_auxiliaries(extracted, path)
                extracted = {key: spark.read.parquet(f"{path}/{key}") for key in extracted}
            tables.update(extracted)
        return tables

    def _auxiliary_sources(self) -> list[str]:
        """What the auxiliaries were computed from, besides the dataset itself."""
        names = [f"auxiliary {self.registry.auxiliaries[name].cache_name}" for name in self.auxiliary_names]
        if names and self.auxiliary_cache:
            names.append(f"of {self.auxiliary_cache.dataset}, extended: {self.inference}")
        return names

    def _extend(self, frame: DataFrame) -> tuple[DataFrame, list[str]]:
        """Raw rows with all features, and the feature names in order."""
        spark = frame.sparkSession
        auxiliaries = self.auxiliaries()
        features: dict[str, Column] = {}
        sources = self._auxiliary_sources()
        for name in self.custom:
            extractor = self.registry.features[name]
            path = self.feature_cache.path(extractor, sources) if self.feature_cache else None
            sources = [*sources, extractor.cache_name]
            if path and is_complete(spark, path):
                frame, names = self._attach(frame, spark.read.parquet(path))
            else:
                result = self.registry.extract(name, frame, dict(features), auxiliaries)
                expressions = _expressions(name, result)
                if expressions is not None:
                    wider = frame.withColumns(expressions)
                elif set(frame.columns) < set(result.columns):
                    wider = self._checked(result)
                else:
                    wider = None
                if wider is not None:
                    names = [c for c in wider.columns if c not in frame.columns]
                    if path and self.cache_all:
                        write_feature(wider, path, names)
                        frame, names = self._attach(frame, spark.read.parquet(path))
                    else:
                        frame = wider
                else:
                    if path:
                        write_feature(result, path, [c for c in result.columns if c not in S.KEYS])
                        result = spark.read.parquet(path)
                    frame, names = self._attach(frame, result)
            features.update({n: F.col(n) for n in names})
        return frame, list(features)

    def _checked(self, feature: DataFrame) -> DataFrame:
        if self.check_contract and not (self._raw_keys_join and key_print(feature) == self._raw_print):
            outcome = contract_report(self.raw, feature).first()
            raise ValueError(f"a feature must have one row per raw row: {outcome.asDict()}")
        return feature

    @cached_property
    def _raw_print(self) -> Row:
        return key_print(self.raw)

    @cached_property
    def _raw_keys_join(self) -> bool:
        """Whether every raw row has a key of its own without a null."""
        repeated = self.raw.groupBy(*S.KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return not self._raw_print["nulls"] and repeated.isEmpty()

    def _attach(self, frame: DataFrame, keyed: DataFrame) -> tuple[DataFrame, list[str]]:
        names = [c for c in keyed.columns if c not in S.KEYS]
        return concat_features([frame, self._checked(keyed).select(*S.KEYS, *names)]), names

    def dataset(self, ordered: bool = False) -> DataFrame:
        """Row key, enabled raw columns, then features in extraction order.

        ``ordered`` adds the total order by row key, which costs a range
        shuffle and is only of use right before an export.
        """
        frame, names = self._extend(self.raw)
        default = [c for c in self.default if c not in S.KEYS]
        assembled = frame.select(*S.KEYS, *default, *names)
        return sort_by_key(assembled) if ordered else assembled


def _expressions(name: str, result) -> dict[str, Column] | None:
    """Expressions by feature name, or None for a table."""
    if isinstance(result, Column):
        return {name: result}
    if isinstance(result, dict) and result and all(isinstance(c, Column) for c in result.values()):
        return result
    if isinstance(result, DataFrame):
        if not set(S.KEYS) < set(result.columns):
            raise TypeError(f"feature table {name} needs the columns {S.KEYS} and a value column")
        return None
    raise TypeError(f"extractor {name} must return a Column, a dict of Columns or a DataFrame, got {type(result)}")


def _tables(name: str, result) -> dict[str, DataFrame]:
    if isinstance(result, dict) and all(isinstance(t, DataFrame) for t in result.values()):
        return result
    raise TypeError(f"auxiliary extractor {name} must return a dict of DataFrames, got {type(result)}")
