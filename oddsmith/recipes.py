"""The model versions as data: which features, target, learner settings and pricing each uses."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, log2

from oddsmith.settings import DEFAULT_WEIGHT, DEFAULT_WEIGHT_CHANGE, SHARE_FLOOR

_STATIC = ("horse_number", "handicap", "age")
_WEIGHT = ("weight", "weight_change")
_JOCKEY = ("jockey_avg_odds", "jockey_win_rate")
_HORSE = ("horse_avg_finish_pos", "horse_avg_popularity", "horse_avg_odds")
_FORM = ("horse_recent_3_avg_finish_pos",)
_SPEED = ("horse_recent_max_speed", "horse_recent_avg_final_600m")
_PREVIOUS = ("prev_finish_pos", "prev_popularity", "prev_odds")
_CLASS = ("horse_max_grade", "horse_is_g1_performer")
# Names of the three aptitude features.
_VENUE = "horse_venue_avg_finish_pos"
_DIST = "horse_dist_avg_finish_pos"
_FIRM = "horse_firm_avg_finish_pos"
_COMBO = ("combo_avg_finish_pos",)


@dataclass(frozen=True)
class Recipe:
    """One model version. ``None`` switches a step off."""

    name: str
    features: tuple[str, ...]
    target: str = "log_share"
    trees: int = 300
    learning_rate: float = 0.03
    leaves: int = 31
    max_depth: int | None = None
    bins: int = 255
    feature_fraction: float = 1.0
    min_rows_per_leaf: int = 20
    seed: int = 42
    k: float = 1.0
    normalise: bool = True
    share_floor: float | None = None
    odds_floor: float | None = None
    zero_train_handicap_diff: bool = False
    zero_fill_scores: bool = False
    jockey_since: str = "2022/01/01"
    recent_since: str = "2024/01/01"
    min_rides: int = 5
    cutoff: str | None = None
    # How announced weights meet the entries: the key, what an entry without one gets, and whether
    # each horse is put back to its weight before the announced change.
    weights_on: tuple[str, ...] = ("horse_name",)
    weight_default: tuple[int, int] | None = (DEFAULT_WEIGHT, DEFAULT_WEIGHT_CHANGE)
    undo_weight_change: bool = False

    @property
    def depth(self) -> int:
        """Tree depth: as deep as the leaves asked for need, and no deeper than ``max_depth``."""
        needed = ceil(log2(self.leaves))
        return needed if self.max_depth is None else min(needed, self.max_depth)

    @property
    def learner(self) -> tuple:
        """The settings that the learner is given."""
        return (
            self.trees, self.learning_rate, self.depth, self.bins, self.feature_fraction,
            self.min_rows_per_leaf, self.seed,
        )

    def changed(self, **changes) -> Recipe:
        """The recipe with other learner settings; a change that the learner would not see fails."""
        other = replace(self, **changes)
        for name, value in changes.items():
            alone = replace(self, **{name: value})
            if value != getattr(self, name) and alone.learner == self.learner:
                raise ValueError(f"{name}={value} gives the same trees as {name}={getattr(self, name)}")
        return other

    @property
    def encodes_sex(self) -> bool:
        return "sex_encoded" in self.features

    def smaller(self, trees: int, depth: int) -> Recipe:
        """The same recipe with a lighter model, for trial runs."""
        return replace(self, trees=trees, max_depth=depth)


_V1 = (*_STATIC, "sex_encoded")
_V3 = (*_V1, *_JOCKEY, *_HORSE)
_V4 = (*_V3, *_FORM)
_V5 = (*_V4, _VENUE, "handicap_diff")
_V6 = (*_V4, _VENUE, _DIST, _FIRM, "handicap_diff")
_V7 = (*_V6, *_SPEED)
_V8 = (*_V7, *_COMBO, "jockey_changed")
_V10 = (*_V8, *_PREVIOUS)
_V11 = tuple(f for f in _V10 if f != "sex_encoded")
_V12 = (*_V11, *_CLASS)
_V13 = (
    *_STATIC, *_WEIGHT, *_JOCKEY, *_HORSE, *_FORM, _VENUE, _DIST, "handicap_diff", *_SPEED,
    "jockey_changed", *_PREVIOUS, *_CLASS,
)
FINAL_FEATURES = (*_V13, *_COMBO)


def _direct(name, features, **changes):
    """Odds predicted as such, not normalised, cut off below at 1.1."""
    base = dict(target="odds", trees=100, learning_rate=0.05, normalise=False, odds_floor=1.1)
    return Recipe(name, features, **{**base, **changes})


def _share(name, features, **changes):
    """Shares predicted, floored, normalised within the race."""
    base = dict(
        target="share", trees=100, learning_rate=0.05, share_floor=SHARE_FLOOR, odds_floor=1.0
    )
    return Recipe(name, features, **{**base, **changes})


def _evaluated(name, features, **changes):
    """Trained before a cutoff and scored against known odds; odds not floored."""
    base = dict(jockey_since="2021/01/01", recent_since="2023/01/01", cutoff="2025/03/01")
    return Recipe(name, features, **{**base, **changes})


RECIPES = {
    recipe.name: recipe
    for recipe in (
        _direct("v1", _V1, learning_rate=0.1),
        _direct("v2", (*_V1, *_JOCKEY), min_rides=10),
        _direct("v3", _V3),
        _share("v4", _V4),
        _share("v5", _V5, zero_train_handicap_diff=True),
        _share("v6", _V6, zero_train_handicap_diff=True),
        _share("v7", _V7, zero_train_handicap_diff=True),
        _share("v8", _V8, zero_train_handicap_diff=True),
        _share("v9", _V8, target="log_share", trees=200, learning_rate=0.03),
        _share("v10", _V10, target="log_share", trees=250, learning_rate=0.03, leaves=40),
        _evaluated("v11", _V11, learning_rate=0.02, leaves=45),
        _evaluated("v12", _V12, trees=400, learning_rate=0.02, leaves=50),
        _evaluated("v13", _V13, max_depth=6, k=1.5, weights_on=("horse_number",), weight_default=None),
        Recipe("v14", FINAL_FEATURES, k=1.5),
        Recipe("v15", FINAL_FEATURES, k=1.5, odds_floor=1.0, undo_weight_change=True),
        Recipe("v16", FINAL_FEATURES, k=1.5, odds_floor=1.0, zero_fill_scores=True),
        Recipe("v17", FINAL_FEATURES, trees=200, learning_rate=0.05, k=1.2),
        Recipe("v18", FINAL_FEATURES, trees=200, learning_rate=0.05),
        Recipe("v19", FINAL_FEATURES, k=1.2, odds_floor=1.0),
    )
}
