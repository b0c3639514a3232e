"""Settings, plain values on the driver that become literals in plans."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

# The four classes.
CLASSES = ("drivable", "rough_terrain", "static_obstacle", "dynamic_object")
DRIVABLE, ROUGH, STATIC, DYNAMIC = range(4)
UNKNOWN = 255
#: Bytes a stored cell is counted with, and bytes of a raw point.
CELL_BYTES, POINT_BYTES = 60, 18


@dataclass(frozen=True)
class Sensor:
    """A spinning lidar."""

    n_beams: int = 64
    fov_up_deg: float = 2.0
    fov_down_deg: float = -24.9
    azimuth_steps: int = 1024
    max_range: float = 100.0
    min_range: float = 1.2
    mount_height: float = 1.73
    range_sigma0: float = 0.015
    range_sigma_rel: float = 0.0012
    dropout: float = 0.015
    rpm: float = 600.0

    @property
    def frame_period(self) -> float:
        return 60.0 / self.rpm


@dataclass(frozen=True)
class Lod:
    """Cell size base_cell * 2 ** level from distance ring_radii[level] on. Fixed values."""

    base_cell: float = 0.05
    n_levels: int = 5
    ring_radii: tuple[float, ...] = (0.0, 10.0, 20.0, 40.0, 70.0)
    max_range: float = 100.0

    def size(self, level: int) -> float:
        return self.base_cell * 2**level


@dataclass(frozen=True)
class Fusion:
    """The elevation filter."""

    z_sigma0: float = 0.02
    z_sigma_rel: float = 0.004
    quantisation_gain: float = 0.35
    process_var: float = 0.0009
    min_var: float = 1e-4
    stale_frames: int = 25
    intensity_keep: float = 0.7
    evidence_keep: float = 0.85
    max_obs: int = 2**30


@dataclass(frozen=True)
class Vehicle:
    """What the platform can do."""

    max_slope_deg: float = 22.0
    max_step_height: float = 0.10
    max_roughness: float = 0.06
    clearance_height: float = 2.4
    nav_cell: float = 0.8


@dataclass(frozen=True)
class Model:
    """Which segmenter runs; sampling zones of the foveated selection. Fixed values."""

    backend: str = "auto"
    architecture: str = "geometric"
    foveal_radius: float = 15.0
    transition_radius: float = 30.0
    transition_stride: int = 1
    far_stride: int = 1


@dataclass(frozen=True)
class Settings:
    sensor: Sensor = field(default_factory=Sensor)
    lod: Lod = field(default_factory=Lod)
    fusion: Fusion = field(default_factory=Fusion)
    vehicle: Vehicle = field(default_factory=Vehicle)
    model: Model = field(default_factory=Model)
    seed: int = 7

    def __post_init__(self):
        lod = self.lod
        problems = {
            f"{len(lod.ring_radii)} ring radii for {lod.n_levels} levels": len(lod.ring_radii) != lod.n_levels,
            "the finest level must start at distance 0": not lod.ring_radii or lod.ring_radii[0] != 0,
            "ring radii must not fall": any(b < a for a, b in zip(lod.ring_radii, lod.ring_radii[1:])),
            "cells must have a size": lod.base_cell <= 0,
            "the grid reaches beyond the sensor": lod.max_range > self.sensor.max_range,
        }
        if found := [text for text, wrong in problems.items() if wrong]:
            raise ValueError("; ".join(found))

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(asdict(self), indent=indent)

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        parts = {"sensor": Sensor, "lod": Lod, "fusion": Fusion, "vehicle": Vehicle, "model": Model}
        made = {}
        for name, kind in parts.items():
            own = dict(values.get(name, {}))
            if "ring_radii" in own:
                own["ring_radii"] = tuple(own["ring_radii"])
            made[name] = kind(**{f.name: own[f.name] for f in fields(kind) if f.name in own})
        return cls(**made, seed=values.get("seed", 7))
