"""What a query over trajectories asks for, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal


def steps(seconds: float, dt: float, up: bool = False) -> int:
    """Whole steps in a number of seconds, worked out in decimal (0.3 / 0.1 is 3, which floats miss)."""
    ratio = Decimal(str(seconds)) / Decimal(str(dt))
    return int(ratio.to_integral_value(ROUND_CEILING if up else ROUND_FLOOR))


def ratio(native_dt: float, wanted_dt: float) -> int:
    """How many wanted steps make a native one, or the negative of the inverse; not a whole number is an error."""
    for a, b, sign in ((native_dt, wanted_dt, 1), (wanted_dt, native_dt, -1)):
        r = Decimal(str(a)) / Decimal(str(b))
        if r >= 1 and r == r.to_integral_value():
            return sign * int(r)
    raise ValueError(f"{native_dt} and {wanted_dt} are no whole multiples of one another")


@dataclass(frozen=True)
class QuerySpec:
    """Windows in seconds (least, most; None: all there is), types, radii and the shape of the answer."""

    dt: float
    history: tuple[float | None, float | None] = (None, None)
    future: tuple[float | None, float | None] = (None, None)
    only_types: frozenset[int] | None = None
    no_types: frozenset[int] = frozenset()
    only_predict: frozenset[int] | None = None
    radii: dict[tuple[int, int], float] = field(default_factory=dict)
    default_radius: float | None = None
    max_neighbors: int | None = None
    centric: str = "agent"
    pad: str = "outside"
    ego_only: bool = False
    with_ego_future: bool = False
    #: Whether the frame's velocity and acceleration are taken off what is seen from it, or those are only turned; whether heights go along.
    relative_derivatives: bool = True
    with_z: bool = False

    def __post_init__(self) -> None:
        if self.centric not in ("agent", "scene"):
            raise ValueError("centric is agent or scene")
        if self.pad not in ("outside", "right"):
            raise ValueError("pad is outside or right")
        if self.ego_only and self.with_ego_future:
            raise ValueError("an ego whose future is given is not predicted")
        if self.dt <= 0:
            raise ValueError("dt is positive")
        for low, high in (self.history, self.future):
            if low is not None and high is not None and low > high:
                raise ValueError("the least of a window is over its most")
        if self.max_neighbors is not None and self.max_neighbors < 0:
            raise ValueError("max_neighbors is not negative")

    def least(self, which: str) -> int:
        low = getattr(self, which)[0]
        return 0 if low is None else steps(low, self.dt, up=True)

    def most(self, which: str) -> int | None:
        high = getattr(self, which)[1]
        return None if high is None else steps(high, self.dt)
