"""Column names that carry a contract leg, and bar lengths."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Suffixes of the far contracts, minutes of a trading day.
LEGS = ("p1", "p2")
TRADING_DAY_MINUTES = 240


@dataclass(frozen=True)
class FieldName:
    """What a column measures, and the far contract it belongs to (None: the row's own)."""

    measure: str
    leg: str | None = None

    @classmethod
    def parse(cls, name: str) -> "FieldName":
        measure, mark, leg = name.rpartition("_")
        return cls(measure, leg) if mark and leg in LEGS else cls(name)

    def __str__(self) -> str:
        return self.measure if self.leg is None else f"{self.measure}_{self.leg}"

    def of(self, measure: str) -> "FieldName":
        """Another measure of the same contract."""
        return FieldName(measure, self.leg)


@dataclass(frozen=True)
class BarLength:
    """A bar of so many clock minutes, or of a whole trading day (None)."""

    minutes: int | None

    @classmethod
    def parse(cls, label: str) -> "BarLength":
        if label == "1d":
            return cls(None)
        if match := re.fullmatch(r"([1-9]\d*)m", label):
            return cls(int(match[1]))
        raise ValueError(f"a bar is '1d' or a number of minutes such as '5m', not {label!r}")

    @property
    def trading_minutes(self) -> int:
        return TRADING_DAY_MINUTES if self.minutes is None else self.minutes
