"""What a panel looks like: key, time, cohort, feature and target columns."""

from __future__ import annotations

from dataclasses import dataclass, field

# Study weeks in which each weekly survey was given.
SURVEY_WEEKS = {
    "phq9": (1, 2, 3, 4, 6, 8, 10, 12),
    "sds": (1, 2, 3, 4),
    "sleep": (0, 4, 8, 12),
    "gic": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
}

# Score bands as (low, high, code); a high of None is open.
ALCOHOL_BANDS = ((0, 0, 0), (1, 3, 1), (4, 6, 2), (7, None, 3))
GAD7_BANDS = ((0, 5, 0), (5, 10, 1), (11, 15, 2), (16, None, 3))
PHQ9_BANDS = ((0, 4, 0), (5, 9, 1), (10, 14, 2), (15, 19, 3), (20, 27, 4))
PHQ9_CUTOFF = ((0, 9, 0), (10, None, 1))
PHQ2_CUTOFF = ((0, 2, 0), (3, None, 1))
UNKNOWN = -1

# Readings at or below these are sensor silence, not behaviour.
SILENCE_THRESHOLDS = {
    "mobility_radius": 0.0015,
    "mobility": 0.03,
    "distance_active_hr": 0,
    "hours_stationary_hr": 0.02,
    "hours_walking_hr": 0.006,
    "hours_of_sleep_hr": 0.08,
}

# Months of each season, in code order.
SEASONS = {
    "fall": (9, 10, 11),
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
}

# Screening limits for the any-of clinical flag.
CLINICAL_LIMITS = {"bipolar": 0, "scz": 0, "gad7_sum": 10, "phq9_sum_base": 15}

# Item groups of the questionnaires, named by rule.
SURVEY_ITEMS = {
    "gad7": tuple(f"gad7_{i}" for i in range(1, 9)),
    "phq9": tuple(f"phq9_{i}" for i in range(1, 10)),
    "phq9_base": tuple(f"phq9_{i}_base" for i in range(1, 10)),
    "phq2": ("phq2_1", "phq2_2"),
    "alc": tuple(f"alc_{i}" for i in range(1, 4)),
    "mhs": tuple(f"mhs_{i}" for i in range(1, 6)),
    "sds": ("sds_1", "sds_2", "sds_3", "stress", "support"),
    "sleep": ("sleep_1", "sleep_2", "sleep_3"),
    "screen": tuple(f"screen_{i}" for i in range(1, 5)),
    "gic": ("mood_1",),
}


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of one panel. Operators take the roles they need from here."""

    key: str = "num_id"
    date: str = "dt"
    week: str = "week"
    day: str = "day"
    cohort: str = "v"
    features: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    demographics: tuple[str, ...] = field(default=())

    @property
    def ids(self) -> tuple[str, ...]:
        return (self.key, self.date, self.week, self.day)

    @property
    def roles(self) -> dict[str, tuple[str, ...]]:
        """Columns by role; a column stands under its first role."""
        return {"id": (*self.ids, self.cohort), "target": self.targets, "demographic": self.demographics, "feature": self.features}

    def role_of(self, column: str, suffixes: tuple[str, ...] = ()) -> tuple[str, str]:
        """(role, suffix) of a column; copies of a feature carry one of the suffixes. Unknown columns have role ``other``."""
        for role, names in self.roles.items():
            if column in names:
                return role, ""
        for suffix in suffixes:
            if suffix and column in self.with_suffix(suffix):
                return "feature", suffix
        return "other", ""

    def with_suffix(self, suffix: str) -> tuple[str, ...]:
        """Names of derived copies, for example ``_hr`` or ``_indicator``."""
        return tuple(f"{c}{suffix}" for c in self.features)

    def weekly_names(self, survey: str, items: tuple[str, ...]) -> list[str]:
        """``{item}_week{n}`` for the weeks in which the survey was given."""
        return [f"{c}_week{w}" for c in items for w in SURVEY_WEEKS[survey]]
