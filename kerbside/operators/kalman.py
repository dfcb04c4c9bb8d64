"""The tracker's Kalman filter on (centre x, centre y, aspect, height) and velocities, float32, of any number of tracks at once.

Each of the four goes with its own velocity only, so the 8 x 8 covariance is four of 2 x 2: a state is an array (..., 6, 4) of places, velocities, and the covariances place-place,
place-velocity, velocity-place and velocity-velocity. All is done element by element, so a track's numbers don't depend, to the bit, on which others are beside it.
"""

from __future__ import annotations

import numpy as np

POSITION, VELOCITY = np.float32(1 / 20), np.float32(1 / 160)


def _spread(h: np.ndarray, by: np.float32, aspect: float) -> np.ndarray:
    """Variances of the four for boxes of height h."""
    found = np.empty((*h.shape, 4), np.float32)
    found[...] = (by * h)[..., None]
    found[..., 2] = aspect
    return found * found


def started(xyah: np.ndarray) -> np.ndarray:
    state, h = np.zeros((*xyah.shape[:-1], 6, 4), np.float32), xyah[..., 3]
    state[..., 0, :], state[..., 2, :], state[..., 5, :] = xyah, _spread(h, 2 * POSITION, 1e-2), _spread(h, 10 * VELOCITY, 1e-5)
    return state


def predicted(state: np.ndarray) -> np.ndarray:
    at, by, pp, pv, vp, vv = np.moveaxis(state, -2, 0)
    new, h = np.empty_like(state), at[..., 3]
    new[..., 0, :], new[..., 1, :] = at + by, by
    new[..., 2, :] = (pp + vp) + (pv + vv) + _spread(h, POSITION, 1e-2)
    new[..., 3, :], new[..., 4, :] = pv + vv, vp + vv
    new[..., 5, :] = vv + _spread(h, VELOCITY, 1e-5)
    return new


def updated(state: np.ndarray, xyah: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after a measurement, and the measurement's squared Mahalanobis distance before it."""
    at, by, pp, pv, vp, vv = np.moveaxis(state, -2, 0)
    seen = pp + _spread(at[..., 3], POSITION, 1e-1)
    gain_p, gain_v, off = pp / seen, pv / seen, xyah - at
    far = off * (off / seen)
    new, through_p, through_v = np.empty_like(state), gain_p * seen, gain_v * seen
    new[..., 0, :], new[..., 1, :] = at + gain_p * off, by + gain_v * off
    new[..., 2, :], new[..., 3, :] = pp - through_p * gain_p, pv - through_p * gain_v
    new[..., 4, :], new[..., 5, :] = vp - through_v * gain_p, vv - through_v * gain_v
    return new, far[..., 0] + far[..., 1] + far[..., 2] + far[..., 3]


def xyah_of(tlwh: np.ndarray) -> np.ndarray:
    x, y, w, h = np.moveaxis(tlwh, -1, 0)
    return np.stack([x + w / 2, y + h / 2, w / h, h], -1).astype(np.float32)


def tlwh_of(state: np.ndarray) -> np.ndarray:
    x, y, a, h = np.moveaxis(state[..., 0, :], -1, 0)
    return np.stack([x - a * h / 2, y - h / 2, a * h, h], -1)


def as_matrix(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, 8 x 8 covariance) of one state."""
    cov, k = np.zeros((8, 8), np.float32), np.arange(4)
    cov[k, k], cov[k, k + 4], cov[k + 4, k], cov[k + 4, k + 4] = state[2:]
    return state[:2].ravel(), cov


def of_matrix(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    k = np.arange(4)
    return np.stack([mean[:4], mean[4:], cov[k, k], cov[k, k + 4], cov[k + 4, k], cov[k + 4, k + 4]]).astype(np.float32)
