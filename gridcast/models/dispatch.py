"""Choice of the forecasting model by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Scorer = Callable[[DataFrame], DataFrame]


class ModelRegistry:
    """Named scorers, each a function from a feature frame to the frame with a forecast."""

    def __init__(self) -> None:
        self._scorers: dict[str, Scorer] = {}

    def register(self, name: str, scorer: Scorer) -> None:
        self._scorers[name] = scorer

    def score(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._scorers:
            raise ValueError(f"Not implemented: {name}")
        return self._scorers[name](df)
