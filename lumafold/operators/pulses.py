"""Pulse and gradient design as small arithmetic: one row of settings each, no data.

Shapes are sampled on a raster; amplitudes in T/m and Hz, areas in 1/m.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from lumafold.operators.feasibility import least_trapezoid


@dataclass(frozen=True)
class ShapedPulse:
    """A sampled RF pulse: magnitude (Hz), raster, frequency offset (Hz), and its slice gradient, if any."""

    magnitude: np.ndarray
    raster: float
    offset: float = 0.0
    gradient: dict[str, float] | None = None

    @property
    def duration(self) -> float:
        return len(self.magnitude) * self.raster

    @property
    def peak_gauss(self) -> float:
        return float(np.abs(self.magnitude).max()) / 42.576e6 * 1e4


def _scaled(shape: np.ndarray, raster: float, flip_deg: float) -> np.ndarray:
    return shape * (flip_deg / 360.0) / (shape.sum() * raster)


def sinc_pulse(flip_deg: float, duration: float, time_bandwidth: float, thickness: float, max_grad: float, max_slew: float, raster: float, gamma: float = 42.576e6) -> ShapedPulse:
    """A Hann-windowed sinc with the gradient that selects ``thickness``."""
    n = round(duration / raster)
    t = (np.arange(n) + 0.5) * raster - duration / 2
    shape = np.sinc(time_bandwidth * t / duration) * (0.5 + 0.5 * np.cos(2 * math.pi * t / duration))
    amplitude = time_bandwidth / duration / thickness / gamma
    if amplitude > max_grad:
        raise ValueError("the slice needs a gradient above the limit")
    rise = math.ceil(amplitude / max_slew / raster - 1e-9) * raster
    return ShapedPulse(_scaled(shape, raster, flip_deg), raster, 0.0, {"amplitude": amplitude, "rise": rise, "flat": duration, "fall": rise})


def excitation_pulse(flip_deg: float, duration: float, time_bandwidth: float, fov_z: float, **limits) -> ShapedPulse:
    """Slab selection over nine tenths of the field of view."""
    return sinc_pulse(flip_deg, duration, time_bandwidth, 0.9 * fov_z, **limits)


def fat_pulse(flip_deg: float, duration: float, time_bandwidth: float, b0: float, raster: float, gamma: float = 42.576e6, shift_ppm: float = 3.45) -> ShapedPulse:
    """A Gaussian pulse at the fat frequency, without a gradient."""
    n = round(duration / raster)
    t = (np.arange(n) + 0.5) * raster - duration / 2
    sigma = duration / (math.pi * time_bandwidth) * 1.2
    return ShapedPulse(_scaled(np.exp(-(t**2) / (2 * sigma**2)), raster, flip_deg), raster, -shift_ppm * 1e-6 * b0 * gamma)


def prephasers(size: tuple[int, int, int], fov: tuple[float, float, float], max_grad: float, max_slew: float, raster: float, gamma: float = 42.576e6) -> list[dict[str, float]]:
    """For each axis the shortest trapezoid of area -n / 2 steps, at half of the gradient limit."""
    return [least_trapezoid(-n / 2 / f, max_grad / 2 * gamma, max_slew * gamma, raster) for n, f in zip(size, fov, strict=True)]


def spoilers(size: tuple[int, int, int], fov: tuple[float, float, float], cycles: float, max_grad: float, max_slew: float, raster: float, gamma: float = 42.576e6) -> list[dict[str, float]]:
    """For each axis the shortest trapezoid that winds ``cycles`` turns in each voxel."""
    return [least_trapezoid(n / f * cycles, max_grad * gamma, max_slew * gamma, raster) for n, f in zip(size, fov, strict=True)]
