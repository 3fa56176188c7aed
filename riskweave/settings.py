"""Analysis settings with their rules."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from .errors import SettingsError

#: Names of algorithms and approximations.
ALGORITHMS = ("bdd", "zbdd", "mocus", "pdag")
APPROXIMATIONS = ("none", "rare-event", "mcub", "monte-carlo")


@dataclass
class Settings:
    """Every assignment is checked; flags imply others as documented at ``__setattr__``."""

    algorithm: str = "bdd"
    approximation: str = "none"
    prime_implicants: bool = False
    limit_order: int = 20
    cut_off: float = 1e-8
    num_trials: int = 1000
    batch_size: int = 1
    sample_size: int = 1
    seed: int = 0
    num_quantiles: int = 20
    num_bins: int = 20
    mission_time: float = 8760.0
    time_step: float = 0.0
    probability_analysis: bool = False
    safety_integrity_levels: bool = False
    importance_analysis: bool = False
    uncertainty_analysis: bool = False
    ccf_analysis: bool = False
    skip_products: bool = False
    preprocessor: bool = False
    print: bool = False
    _ready: bool = field(default=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "_ready", True)
        for f in fields(self):
            if f.name != "_ready":
                setattr(self, f.name, getattr(self, f.name))

    def __setattr__(self, name: str, value) -> None:
        """Set one value. mocus and zbdd approximate by rare events unless told otherwise; importance and uncertainty
        analyses and integrity levels turn the probability analysis on, which then stays on; integrity levels need a time step."""
        if self.__dict__.get("_ready"):
            if name == "probability_analysis" and not value and (self.importance_analysis or self.uncertainty_analysis or self.safety_integrity_levels):
                return  # stays on
            self._check(name, value)
        object.__setattr__(self, name, value)
        if not self.__dict__.get("_ready"):
            return
        if name == "algorithm" and value != "bdd":
            if self.prime_implicants:
                raise SettingsError("prime implicants need the bdd algorithm")
            if value in ("mocus", "zbdd") and self.approximation == "none":
                object.__setattr__(self, "approximation", "rare-event")
        if name in ("importance_analysis", "uncertainty_analysis", "safety_integrity_levels") and value:
            object.__setattr__(self, "probability_analysis", True)

    def _check(self, name: str, value) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise SettingsError(f"{name}: {what}, not {value!r}")

        if name == "algorithm":
            need(value in ALGORITHMS, f"one of {', '.join(ALGORITHMS)}")
        elif name == "approximation":
            need(value in APPROXIMATIONS, f"one of {', '.join(APPROXIMATIONS)}")
            need(not (self.prime_implicants and value in ("rare-event", "mcub")), "no product-based approximation with prime implicants")
        elif name == "prime_implicants" and value:
            need(self.algorithm == "bdd", "prime implicants need the bdd algorithm")
            object.__setattr__(self, "approximation", "none")
        elif name in ("limit_order", "seed"):
            need(value >= 0, "not negative")
        elif name == "cut_off":
            need(0 <= value <= 1, "within [0, 1]")
        elif name in ("num_trials", "num_quantiles", "num_bins", "batch_size", "sample_size"):
            need(value >= 1, "at least 1")
        elif name == "mission_time":
            need(value >= 0, "not negative")
        elif name == "time_step":
            need(value >= 0, "not negative")
            need(value > 0 or not self.safety_integrity_levels, "positive while integrity levels are asked for")
        elif name == "safety_integrity_levels" and value:
            need(self.time_step > 0, "a time step first")
