"""Column roles of a panel of time series."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns identify a series, order it and carry its numbers.

    ``ties`` lists the columns that make the order total where the time alone
    is not unique. ``features`` are extra numeric covariates; the target always
    comes first in :attr:`columns`.
    """

    keys: tuple[str, ...] = ("series_id",)
    time: str = "ts"
    value: str = "value"
    ties: tuple[str, ...] = ()
    features: tuple[str, ...] = ()

    @property
    def order(self) -> list[str]:
        return [self.time, *self.ties]

    @property
    def columns(self) -> list[str]:
        return [self.value, *[c for c in self.features if c != self.value]]

    def using(self, **changes) -> "SeriesSpec":
        return replace(self, **changes)
