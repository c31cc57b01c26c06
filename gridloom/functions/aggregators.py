"""Resampling of 2 x 2 blocks: seven rules over samples in the order 0 1 / 2 3, without nodata (NaN)."""

from __future__ import annotations

import numpy as np


def _split(a: np.ndarray) -> np.ndarray:
    """(4, h/2, w/2)"""
    return np.stack([a[0::2, 0::2], a[0::2, 1::2], a[1::2, 0::2], a[1::2, 1::2]])


def _mean(s, whole):
    n = (~np.isnan(s)).sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        m = np.nansum(s, 0) / np.where(n, n, np.nan)
    return np.trunc(m) if whole else m


def _sum(s, whole):
    return np.where((~np.isnan(s)).any(0), np.nansum(s, 0), np.nan)


def _mode(s, whole):
    """Most frequent; of equally frequent values the smallest."""
    count = (s[:, None] == s[None, :]).sum(1).astype(float)
    key = np.where(np.isnan(s), -1, count)
    best = key.max(0)
    return np.where(best > 0, np.where(key == best, s, np.inf).min(0), np.nan)


def _nearest(s, whole):
    out = np.full(s.shape[1:], np.nan)
    for k in (2, 3, 1, 0):
        out = np.where(np.isnan(s[k]), out, s[k])
    return out


def _min(s, whole):
    return np.fmin.reduce(s, 0)


def _max(s, whole):
    return np.fmax.reduce(s, 0)


def _min_average_pair(s, whole):
    t = np.sort(s, 0)
    m = (t[0] + t[1]) / 2
    return np.trunc(m) if whole else m


RULES = {"MEAN": _mean, "SUM": _sum, "MODE": _mode, "NEAREST": _nearest, "MIN": _min, "MAX": _max, "MINAVGPAIR": _min_average_pair}


def reduce(a: np.ndarray, rule: str, whole: bool = False) -> np.ndarray:
    """Half the size in both directions; whole: integer cells, whose means are truncated."""
    if rule.upper() not in RULES:
        raise ValueError(f"unknown aggregator {rule!r}; known are {', '.join(RULES)}")
    return RULES[rule.upper()](_split(a), whole)


def weighted_mean(samples, x: float, y: float) -> float:
    """Of samples in the order 0 1 / 2 3 the value at (x, y) between them, 0 to 1 each; nodata (NaN) is left out."""
    a = np.asarray(samples, float)
    w = np.array([(1 - x) * (1 - y), x * (1 - y), (1 - x) * y, x * y]) * ~np.isnan(a)
    return float((w * np.nan_to_num(a)).sum() / w.sum()) if w.sum() > 0 else float("nan")
