"""The clip of returns by their own weighted volatility: as a loop, and as a map from the variance before a block to the one after it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import sqrt

SIGMAS = 5.0
#: A series whose volatility isn't above this is dead: its returns are cut to 0 and its variance stays.
DEAD = 1e-8


def clip(rets: Sequence[float], decay: float, var: float, sigmas: float = SIGMAS) -> tuple[list[float], float]:
    """Returns cut to sigmas times the volatility known before them, and the variance after them; var is the one before."""
    out = []
    for r in rets:
        vol = sqrt(var)
        cut = 0.0
        if vol > DEAD:
            cut = max(-sigmas * vol, min(sigmas * vol, r))
            var = decay * var + (1 - decay) * cut * cut
        out.append(cut)
    return out, var


Line = tuple[float, float]


def lower(lines: list[Line], floor: float) -> list[Line]:
    """Those of the rising lines (slope, offset) that are the lowest one somewhere above floor, by falling slope."""
    kept: list[Line] = []
    cross = lambda a, b: (b[1] - a[1]) / (a[0] - b[0])
    for line in sorted(lines, key=lambda x: (-x[0], x[1])):
        if kept and kept[-1][0] == line[0]:
            continue
        while kept and (line[1] <= kept[-1][1] or len(kept) > 1 and cross(kept[-1], line) <= cross(kept[-2], kept[-1])):
            kept.pop()
        kept.append(line)
    first = 0
    while first + 1 < len(kept) and cross(kept[first], kept[first + 1]) <= floor:
        first += 1
    return kept[first:]


class ClipMap:
    """What a block of returns makes of the variance before it.

    While a series is alive, a return takes its variance v to the lesser of decay * v + (1 - decay) * r^2 and, if r is cut,
    (decay + (1 - decay) * sigmas^2) * v. Both are rising lines in v, so a block is the lower envelope of lines. dies is the
    largest variance with which the series is dead at the end; for such ones the block has to be gone through.
    """

    def __init__(self, rets: Sequence[float], decay: float, sigmas: float = SIGMAS):
        self.decay, self.sigmas, self.rets = decay, sigmas, rets
        floor = DEAD * DEAD
        up = decay + (1 - decay) * sigmas * sigmas
        self.lines: list[Line] = [(1.0, 0.0)]
        self.dies = floor
        for r in rets:
            gain = (1 - decay) * r * r
            self.lines = lower([(decay * s, decay * c + gain) for s, c in self.lines] + [(up * s, up * c) for s, c in self.lines], floor)
            self.dies = max([self.dies, *((floor - c) / s for s, c in self.lines if s > 0)])

    @classmethod
    def known(cls, rets: Sequence[float], lines: Iterable[Line], dies: float, decay: float, sigmas: float = SIGMAS) -> ClipMap:
        """The map that has these lines; rets may be empty if it was never to be gone through."""
        out = cls((), decay, sigmas)
        out.rets, out.lines, out.dies = rets, list(lines), dies
        return out

    def __call__(self, var: float) -> float:
        # a hair above, so that rounding doesn't decide on which side of the edge a variance lies
        if var <= self.dies * (1 + 1e-9):
            # a series that was dead before stays as it is
            return clip(self.rets, self.decay, var, self.sigmas)[1]
        return min(s * var + c for s, c in self.lines)
