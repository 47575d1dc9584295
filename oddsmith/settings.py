"""Parameters shared by all jobs. Every function takes them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Pari-mutuel constants and search bounds the results depend on.
PAYOUT = 0.8
SHARE_FLOOR = 0.001
DEFAULT_WEIGHT = 490
DEFAULT_WEIGHT_CHANGE = 0
CALIBRATION_K = 1.2
K_GRID = tuple(1.0 + g * 0.1 for g in range(21))


@dataclass(frozen=True)
class Course:
    """The conditions a model is trained for."""

    venue_code: str = "06"
    distance: int = 1200
    surface: str = "芝"
    firm: str = "良"


@dataclass(frozen=True)
class HistoryWindow:
    """How far back the jockey and the recent-form features look.

    Snapshot features start at the given dates (``yyyy/MM/dd``, compared as text);
    point-in-time features look back the given number of days from each race.
    """

    jockey_since: str = "2022/01/01"
    recent_since: str = "2024/01/01"
    min_rides: int = 5
    jockey_days: int = 1461
    recent_days: int = 730
