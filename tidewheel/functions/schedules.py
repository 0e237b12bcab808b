"""Closed-form numeric schedules: learning rates, diffusion, prefix weights, image geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_cosine(step: Column, peak: float, warmup: int, decay: int, end: float) -> Column:
    """Linear from peak / (warmup + 1) to peak, then a cosine down to end at step `decay`."""
    first = peak / (warmup + 1)
    share = F.least(F.lit(1.0), (step - warmup) / float(decay - warmup))
    return F.when(step < warmup, first + (peak - first) * step / float(warmup)).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(math.pi * share)))


def warmup_rsqrt(step: Column, peak: float, warmup: int, timescale: float) -> Column:
    """Linear as above, then peak over the root of 1 + (steps since) / timescale."""
    first = peak / (warmup + 1)
    return F.when(step < warmup, first + (peak - first) * step / float(warmup)).otherwise(peak / F.sqrt((timescale + step - warmup) / timescale))


def warmup_linear(step: Column, peak: float, warmup: int = 500) -> Column:
    return peak * F.least((step + 1) / float(warmup), F.lit(1.0))


def cosine_betas(i: Column, n: int) -> Column:
    """Noise of step i of n such that the kept signal follows a squared cosine; at most 0.999."""
    kept = lambda t: F.pow(F.cos((t + 0.008) / 1.008 * math.pi / 2), F.lit(2.0))
    return F.least(1 - kept((i + 1) / float(n)) / kept(i / float(n)), F.lit(0.999))


def linear_betas(i: Column, n: int, start: float, end: float) -> Column:
    return start + i * ((end - start) / max(1, n - 1))


def denoise(sample: Column, noise_guess: Column, kept: Column, kept_before: Column, noise: Column, sampler: str, clip: bool) -> Column:
    """One reverse step. kept and kept_before are the cumulative products at this step and the one before (1 at the end)."""
    if sampler not in ("ddpm", "ddim"):
        raise ValueError("sampler must be ddpm or ddim")
    lost = 1 - kept
    clean = (sample - F.sqrt(lost) * noise_guess) / F.sqrt(kept)
    if clip:
        clean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), clean))
    if sampler == "ddim":
        return F.sqrt(kept_before) * clean + F.sqrt(1 - kept_before) * noise_guess
    step = kept / kept_before
    mean = F.sqrt(kept_before) * (1 - step) / lost * clean + F.sqrt(step) * (1 - kept_before) / lost * sample
    return mean + F.sqrt(F.greatest(F.lit(0.0), (1 - kept_before) / lost * (1 - step))) * noise


def prefix_weight(i: Column, delay: int, prefix: int, available: int, horizon: int) -> Column:
    """Weight of step i of a chunk: 1 up to the delay, falling exponentially to the prefix's end, then 0."""
    end = min(max(prefix, 0), min(max(available, 0), horizon))
    start = min(max(delay, 0), end)
    linear = 1 - (i - start + 1) / float(end - start + 1)
    return F.when(i < start, 1.0).when(i < end, linear * (F.exp(linear) - 1) / (math.e - 1)).otherwise(0.0)


def letterbox(h: Column, w: Column, height: int, width: int) -> dict[str, Column]:
    """Size of an image fitted into height x width, and its offset from the top left."""
    ratio = F.greatest(w / float(width), h / float(height))
    rh, rw = F.floor(h / ratio), F.floor(w / ratio)
    return {"rh": rh, "rw": rw, "top": F.floor((height - rh) / 2), "left": F.floor((width - rw) / 2)}


def pixel_to_unit(x: Column) -> Column:
    """0..255 onto -1..1."""
    return x / 255.0 * 2.0 - 1.0


def unit_to_pixel(x: Column) -> Column:
    """0..1 onto 0..255, cut to a byte's range."""
    return F.greatest(F.lit(0), F.least(F.lit(255), (x * 255).cast("int")))
