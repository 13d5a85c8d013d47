"""Numbers of tables that customers of one dish sit at, drawn from their exact law.

A dish of c customers whose new tables have weight `fresh` has t tables with probability in proportion to S(c, t) fresh^t,
where S are the generalized Stirling numbers of the discount: the law that Gibbs sampling of single customers approaches.
A draw seats all customers of the dish anew at once.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np

from packwise.llm.words import mix

NODES = 100  # of the integral for larger Stirling numbers
SMALL = 1024  # up to so many customers the row of Stirling numbers is made by its recurrence
_log_gamma = np.frompyfunc(lgamma, 1, 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def uniforms(seeds: np.ndarray, place: int) -> np.ndarray:
    """The number at `place` of each seed's own row of random numbers, inside (0, 1)."""
    with np.errstate(over="ignore"):
        bits = mix(mix(seeds + _STEP * np.uint64(place + 1)))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def next_row(row: np.ndarray, discount: float) -> np.ndarray:
    """log S(c + 1, 1..c + 1) from log S(c, 1..c)."""
    c = len(row)
    stay = row + np.log(c - discount * np.arange(1, c + 1))
    return np.logaddexp(np.append(stay, -np.inf), np.concatenate([[-np.inf], row]))


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float, nodes: int = NODES) -> np.ndarray:
    """log (S(c, t) / c!) for 1 <= t <= c, to about eleven digits.

    S(c, t) t! / c! is the coefficient of z^c in phi(z)^t, phi(z) = (1 - (1 - z)^discount) / discount. With z = exp(-s) it is an
    inverse Laplace transform, taken by the trapezoidal rule on a parabola through the saddle point; near t = c on a line.
    """
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    if len(c) > 4096:  # bounds the working arrays
        return np.concatenate([log_stirling(c[k : k + 4096], t[k : k + 4096], discount, nodes) for k in range(0, len(c), 4096)])

    def log_phi(s):
        return np.log(-np.expm1(discount * np.log(-np.expm1(-s))) / discount)

    low, high = np.full(c.shape, -60.0), np.full(c.shape, 3.5)
    for _ in range(50):  # the saddle point, as its logarithm
        middle = (low + high) / 2
        s = np.exp(middle)
        q = -np.expm1(-s)
        above = c > t * discount * q ** (discount - 1) * np.exp(-s) / -np.expm1(discount * np.log(q))
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    at = np.maximum(np.exp(high), 1 / c)
    height = c * at + t * log_phi(at)
    x = np.linspace(0, 1, nodes + 1)
    weights = np.ones(nodes + 1)
    weights[[0, -1]] = 0.5
    on_line, alone = t > 0.9 * c, t == c
    out = np.zeros(c.shape)
    for part, line in ((np.flatnonzero(~on_line), False), (np.flatnonzero(on_line & ~alone), True)):
        if not len(part):
            continue
        cc, tt, a, h = (v[part] for v in (c, t, at, height))
        if line:
            small = 1e-3 * a
            bend = (tt * log_phi(a + small) + tt * log_phi(a - small) - 2 * tt * log_phi(a)) / small**2
            reach = np.minimum(np.pi, 12 / np.sqrt(np.maximum(bend, 1e-300)))
            s, slope, scale = a[:, None] + 1j * reach[:, None] * x, 1.0, reach / np.pi
        else:
            reach = 7 / np.sqrt((1 - discount) * cc * a)
            turn = 1 + 1j * reach[:, None] * x
            s, slope, scale = a[:, None] * turn**2, turn, reach * 2 * a / np.pi
        value = ((np.exp(cc[:, None] * s + tt[:, None] * log_phi(s) - h[:, None]) * slope).real * weights).sum(1)
        out[part] = h + np.log(np.maximum(value * scale / nodes, 1e-300))
    return out - _log_gamma(t + 1).astype(float)  # t = c: the coefficient is 1


def drawn_tables(customers: np.ndarray, fresh: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish, (samples, dishes) as the seeds; a dish's random numbers come from its own seeds, so that its place among
    others does not matter."""
    out = np.repeat((customers > 0).astype(np.int64)[None], len(seeds), 0)
    log_fresh = np.log(np.maximum(fresh, 1e-300))
    few = np.flatnonzero((customers > 1) & (customers <= SMALL))
    few = few[np.argsort(customers[few], kind="stable")]
    sizes, first = np.unique(customers[few], return_index=True)
    last = np.append(first, len(few))[1:]
    for size, low, high in zip(sizes.tolist(), first.tolist(), last.tolist(), strict=True):
        row, t = _row(size, discount), np.arange(1, size + 1)
        step = max(1, 1_000_000 // size)
        for k in range(low, high, step):
            dishes = few[k : min(high, k + step)]
            logs = row + t * log_fresh[dishes, None]
            upto = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            for sample, seed in zip(out, seeds, strict=True):
                sample[dishes] = 1 + (upto < (uniforms(seed[dishes], 0) * upto[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(customers > SMALL)
    for k in range(0, len(many), 2000):
        dishes = many[k : k + 2000]
        out[:, dishes] = _drawn_from_many(customers[dishes], log_fresh[dishes], discount, seeds[:, dishes])
    return out


@lru_cache(maxsize=8)
def _rows(discount: float) -> list[np.ndarray]:
    rows = [np.zeros(1)]
    while len(rows) < SMALL:
        rows.append(next_row(rows[-1], discount))
    return rows


def _row(c: int, discount: float) -> np.ndarray:
    return _rows(discount)[c - 1]


def _drawn_from_many(c: np.ndarray, log_fresh: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Rejection under a flat top with geometric tails; the law is log-concave, so the slopes at both ends of the top bound it."""

    def log_p(t, of=slice(None)):
        inside = (t >= 1) & (t <= c[of])
        return np.where(inside, log_stirling(c[of], np.clip(t, 1, c[of]), discount) + t * log_fresh[of], -np.inf)

    c = c.astype(np.int64)
    low, high, step = np.ones(len(c), np.int64), c.copy(), np.ones(len(c), np.int64)
    middle = np.clip(np.rint(_near_mode(c, log_fresh, discount)), 1, c).astype(np.int64)
    seen_up, seen_down = low == high, low == high
    while len(of := np.flatnonzero(low < high)):  # the most probable number: doubled steps until it is passed, then halves
        t = np.maximum(middle[of], 2)
        up = log_p(t, of) >= log_p(t - 1, of)
        low[of], high[of] = np.where(up, t, low[of]), np.where(up, high[of], t - 1)
        seen_up[of] |= up
        seen_down[of] |= ~up
        halves = (low[of] + high[of] + 1) // 2
        far = np.where(up, np.minimum(low[of] + step[of], high[of]), np.maximum(high[of] + 1 - step[of], low[of] + 1))
        middle[of] = np.where(seen_up[of] & seen_down[of], halves, far)
        step[of] *= 2
    top = log_p(low)
    bend = 2 * top - log_p(np.maximum(low - 1, 1)) - log_p(np.minimum(low + 1, c))
    width = np.ceil(1 / np.sqrt(np.clip(bend, 1e-12, 1.0))).astype(np.int64)
    left, right = np.maximum(1, low - width), np.minimum(c, low + width)
    at_left, at_right = log_p(left), log_p(right)
    fall_left, fall_right = (np.maximum(a - log_p(b), 1e-9) for a, b in ((at_left, left - 1), (at_right, right + 1)))
    # masses of both tails and of the top; a fall of infinity leaves nothing
    tails = [np.exp(a - top) / np.expm1(np.minimum(f, 700)) for a, f in ((at_left, fall_left), (at_right, fall_right))]
    flat = (right - left + 1).astype(float)
    out, seeds = np.zeros(seeds.size, np.int64), seeds.ravel()
    open_, place = np.arange(len(out)), 0
    while len(open_):
        u, v, w = (uniforms(seeds[open_], place + k) for k in range(3))
        place += 3
        of = open_ % len(c)
        mass = u * (flat + tails[0] + tails[1])[of]
        is_flat = mass < flat[of]
        is_left = ~is_flat & (mass < (flat + tails[0])[of])
        far = 1 + np.floor(np.log(v) / -np.where(is_left, fall_left[of], fall_right[of]))
        far = np.minimum(far, 2.0**50).astype(np.int64)
        t = np.where(is_flat, left[of] + np.floor(v * flat[of]).astype(np.int64), np.where(is_left, left[of] - far, right[of] + far))
        bound = np.where(is_flat, top[of], np.where(is_left, at_left[of] - far * fall_left[of], at_right[of] - far * fall_right[of]))
        taken = (t >= 1) & (t <= c[of])
        taken[taken] = np.log(w[taken]) <= log_p(t[taken], of[taken]) - bound[taken]
        out[open_[taken]] = t[taken]
        open_ = open_[~taken]
    return out.reshape(-1, len(c))


def _near_mode(c: np.ndarray, log_fresh: np.ndarray, discount: float) -> np.ndarray:
    """The saddle point of the sum over all numbers of tables: c = -fresh phi'(s), t = fresh phi(s)."""
    low, high = np.full(len(c), -200.0), np.full(len(c), 3.5)
    for _ in range(50):
        middle = (low + high) / 2
        s = np.exp(middle)
        above = np.log(c) > log_fresh + (discount - 1) * np.log(-np.expm1(-s)) - s
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return np.minimum(np.exp(log_fresh) * -np.expm1(discount * np.log(-np.expm1(-np.exp(high)))) / discount, c)
