"""Band and trial geometry, checked once and shared by every plan and operator."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Dispersion constant in MHz^2 s per pc cm^-3; the simulator's usual value differs in the fifth digit.
DISPERSION = 1 / 2.41e-4
SIMULATOR_DISPERSION = 4.148808e3


@dataclass(frozen=True)
class Geometry:
    """A tree transform's band (channel 0 lowest), sampling and range of trial delays (in samples over the band)."""

    f_min: float
    f_max: float
    nchans: int
    nsamps: int
    tsamp: float
    dt_max: int
    dt_step: int = 1
    dt_min: int = 0
    dispersion: float = DISPERSION
    precision: str = "float64"

    def __post_init__(self):
        for ok, what in (
            (0 < self.f_min < self.f_max, "0 < f_min < f_max"),
            (self.nchans >= 1, "nchans >= 1"),
            (self.nsamps >= 1, "nsamps >= 1"),
            (self.tsamp > 0, "tsamp > 0"),
            (self.dt_step >= 1, "dt_step >= 1"),
            (0 <= self.dt_min <= self.dt_max, "0 <= dt_min <= dt_max"),
            (self.precision in ("float64", "float32"), "precision is float64 or float32"),
        ):
            if not ok:
                raise ValueError(f"geometry needs {what}")

    @property
    def df(self) -> float:
        return (self.f_max - self.f_min) / self.nchans

    @property
    def correction(self) -> float:
        return self.df / 2

    @property
    def niters(self) -> int:
        return (self.nchans - 1).bit_length()

    @property
    def dm_step(self) -> float:
        return self.tsamp / (self.dispersion * (self.f_min**-2 - self.f_max**-2))


@dataclass(frozen=True)
class DirectGeometry:
    """A direct transform's band, sampling and trial dispersion measures."""

    f_min: float
    f_max: float
    nchans: int
    tsamp: float
    dms: tuple[float, ...]
    dispersion: float = DISPERSION

    def __post_init__(self):
        for ok, what in ((0 < self.f_min < self.f_max, "0 < f_min < f_max"), (self.nchans >= 1, "nchans >= 1"), (self.tsamp > 0, "tsamp > 0"), (len(self.dms) > 0, "at least one DM")):
            if not ok:
                raise ValueError(f"direct geometry needs {what}")

    @classmethod
    def from_range(cls, f_min, f_max, nchans, tsamp, dm_max, dm_step, dm_min=0.0, **more) -> DirectGeometry:
        return cls(f_min, f_max, nchans, tsamp, dm_range(dm_max, dm_step, dm_min), **more)

    def delays(self) -> np.ndarray:
        """(DM, channel) delays in samples, signed, relative to the lowest channel: 0 or negative for positive DMs."""
        f = self.f_min + np.arange(self.nchans) * (self.f_max - self.f_min) / self.nchans
        raw = self.dispersion / self.tsamp * (f**-2.0 - self.f_min**-2.0)[None, :] * np.array(self.dms)[:, None]
        return half_away(raw).astype(np.int64)


def dm_range(dm_max: float, dm_step: float, dm_min: float = 0.0) -> tuple[float, ...]:
    """dm_min, dm_min + dm_step, ... up to dm_max, the end included where it is on the grid."""
    if dm_step <= 0 or dm_max < dm_min:
        raise ValueError("a DM range needs dm_step > 0 and dm_min <= dm_max")
    n = int(np.floor((dm_max - dm_min) / dm_step + 1e-9)) + 1
    return tuple(float(dm_min + i * dm_step) for i in range(n))


def half_away(x):
    """Rounds halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)
