"""Registry of feature and auxiliary extractors."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

FeatureResult = Column | dict[str, Column] | DataFrame


@dataclass(frozen=True)
class Extractor:
    """A named function with a version that is part of its cache key."""

    name: str
    function: Callable
    version: str = "1"

    @property
    def cache_name(self) -> str:
        return f"{self.name}-v{self.version}"


def _arity(function: Callable) -> int:
    kinds = (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD)
    return sum(p.kind in kinds for p in inspect.signature(function).parameters.values())


@dataclass
class Registry:
    """Extractors by name.

    A feature extractor is ``f(raw_data, features, auxiliaries)`` and returns a
    ``Column``, a dict of ``Column``s, ``raw_data`` with more columns, or any other
    DataFrame with the row key; a function without the third argument is
    accepted too. ``raw_data`` includes the features extracted before. An auxiliary extractor is
    ``f(raw_data, auxiliary_train=None)`` and returns a dict of DataFrames.
    """

    features: dict[str, Extractor] = field(default_factory=dict)
    auxiliaries: dict[str, Extractor] = field(default_factory=dict)

    def feature(self, name: str | None = None, version: str = "1"):
        def register(function):
            key = name or function.__name__
            self.features[key] = Extractor(key, function, version)
            return function

        return register

    def auxiliary(self, name: str | None = None, version: str = "1"):
        def register(function):
            key = name or function.__name__
            self.auxiliaries[key] = Extractor(key, function, version)
            return function

        return register

    def extract(self, name: str, raw: DataFrame, features: dict, auxiliaries: dict) -> FeatureResult:
        function = self.features[name].function
        arguments = (raw, features, auxiliaries)
        return function(*arguments[: max(2, min(3, _arity(function)))])
