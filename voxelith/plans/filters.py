"""Filter stages as a logical plan: defaults, limits, spacing, reach, signature, and the choice of execution."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import slabs
from ..operators.kernels import KERNELS, weights

#: Default, least and largest of each parameter (None: no limit).
PARAMETERS = {
    "spikeHole": {"strength": (0.5, 0, 1), "thresholdHU": (100, 20, 1000)},
    "nlm": {"hHU": (40, 5, 300), "searchRadius": (1, 1, 2), "patchRadius": (1, 0, 2)},
    "anisotropic": {"strength": (0.45, 0, 1), "kappaHU": (60, 5, 300), "iterations": (4, 1, 12)},
    "gaussian": {"strength": (0.4, 0, 1), "passes": (2, 1, 6)},
    "median": {"strength": (0.4, 0, 1), "passes": (2, 1, 6)},
    "sigmoid": {"strength": (0.5, 0, 1), "center": (0, None, None), "width": (300, 20, 1000)},
    "bilateral": {"strength": (0.8, 0, 1), "spatialSigma": (1.2, 0.5, 2.5), "sigmaHU": (50, 10, 300), "passes": (2, 1, 3)},
    "tv": {"weight": (0.12, 0.01, 0.3), "iterations": (8, 1, 20), "epsHU": (1, None, None)},
    "unsharp": {"radius": (1, 1, 3), "amount": (0.8, 0, 2), "thresholdHU": (60, 0, 500)},
}
SPACING_AWARE = ("anisotropic", "tv", "gaussian", "bilateral", "nlm", "unsharp")
#: Version of each algorithm that works in HU.
VERSIONS = {"spikeHole": 2, "nlm": 2, "anisotropic": 3, "tv": 2, "unsharp": 2, "bilateral": 2}
#: How older projects, which stored shares of the value range, give HU.
LEGACY = {
    ("spikeHole", "thresholdHU"): lambda s, span: s.get("threshold", 0.075) * span,
    ("nlm", "hHU"): lambda s, span: span * (0.018 + 0.11 * s.get("strength", 0.45)),
    ("anisotropic", "kappaHU"): lambda s, span: span * (0.025 + 0.09 * s.get("strength", 0.45)),
    ("tv", "epsHU"): lambda s, span: 1e-4 * span,
    ("unsharp", "thresholdHU"): lambda s, span: s.get("threshold", 0.02) * span,
    ("bilateral", "sigmaHU"): lambda s, span: s.get("intensitySigma", 0.02) * span,
}


def usable(key: str, name: str, value) -> bool:
    """Finite and positive, or zero where the range starts there."""
    if not isinstance(value, (int, float)) or not math.isfinite(value):
        return False
    return value >= 0 if PARAMETERS[key][name][1] == 0 else value > 0


def resolve(key: str, saved: dict, value_range: tuple[float, float] | None = None) -> tuple[dict, list[str]]:
    """HU parameters of a stored stage: stored ones hold, missing ones come from older shares, else defaults.  Also the names that fell back."""
    out, fallen = dict(saved), []
    for (k, name), derive in LEGACY.items():
        if k != key or usable(key, name, saved.get(name)):
            continue
        value = None
        if value_range is not None and all(map(math.isfinite, value_range)):
            value = round(derive(saved, max(1.0, value_range[1] - value_range[0])) * 1e6) / 1e6
        if usable(key, name, value):
            out[name] = value
        else:
            out[name] = PARAMETERS[key][name][0]
            fallen.append(name)
    return out, fallen


@dataclass(frozen=True)
class Stage:
    key: str
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        known = PARAMETERS.get(self.key)
        if known is None:
            raise ValueError(f"no such filter: {self.key}")
        for name, value in self.params.items():
            if name == "sp":
                continue
            if name not in known:
                raise ValueError(f"{self.key} has no {name}")
            _, low, high = known[name]
            if not math.isfinite(value) or (low is not None and not low <= value <= high):
                raise ValueError(f"{self.key}: {name} must lie between {low} and {high}")

    @property
    def full(self) -> dict:
        return {n: d for n, (d, _, _) in PARAMETERS[self.key].items()} | self.params

    @property
    def identity(self) -> bool:
        return self.full.get("strength") == 0 and self.key in ("gaussian", "median", "sigmoid", "bilateral")


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...] = ()

    def add(self, key: str, **params) -> Pipeline:
        return Pipeline((*self.stages, Stage(key, params)))

    def move(self, at: int, to: int) -> Pipeline:
        s = list(self.stages)
        s.insert(to, s.pop(at))
        return Pipeline(tuple(s))

    def compiled(self, spacing=(1.0, 1.0, 1.0)) -> list[tuple[str, dict]]:
        """Stages that do something, with spacing weights where they count."""
        sp = weights(spacing)
        return [(s.key, s.full | ({"sp": sp} if sp and s.key in SPACING_AWARE else {})) for s in self.stages if not s.identity]

    def reach(self) -> int:
        return slabs.halo(self.compiled())

    def signature(self, spacing=(1.0, 1.0, 1.0)) -> str:
        stages = [{"key": k, "params": p, "algo": VERSIONS.get(k, 1)} for k, p in self.compiled(spacing)]
        return hashlib.sha256(json.dumps(stages, sort_keys=True).encode()).hexdigest()

    def run(self, planes: DataFrame, depths: DataFrame, w: int, h: int, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
        """One shuffle for the whole chain; slabs are as deep as memory allows."""
        stages = self.compiled(spacing)
        return slabs.run(planes, depths, stages, slabs.slab_depth(w, h, slabs.halo(stages))) if stages else planes


def register(key: str, kernel, parameters: dict) -> None:
    """Add a filter: a function of (block, parameters) with its reach, and its parameters' defaults and limits."""
    KERNELS[key] = kernel
    PARAMETERS[key] = parameters
