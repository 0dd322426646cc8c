"""Parameters that fix the semantics of the map, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MapConfig:
    resolution: float = 0.2
    min_safe: float = 0.8
    full_safe: float = 3.0
    radius_cap: float = 3.0
    reserve: float = 0.2
    #: Half side of the neighbour box of a map tick; None: edges of any length.
    edge_box: float | None = None
    safety_weight: float = 50.0
    safety_bias: float = 0.0
    snap_distance: float = 10.0
    update_box: float = 70.0
    update_box_hires: float = 40.0
    grow_radius: float = 5.0
    merge_radius: float = 10.0
    fragment_bytes: int = 500
    header_bytes: int = 10
    segment_bytes: int = 13
    portal_bytes: int = 4
    send_interval_s: float = 2.0

    def with_safety(self, weight: float) -> MapConfig:
        """The answer of the parameter service: a new weight, and the bias back at zero."""
        return replace(self, safety_weight=weight, safety_bias=0.0)

    def box_half(self, resolution: float) -> float:
        """Half side of the work box; fine maps (under 0.18 m) get the smaller one."""
        return (self.update_box_hires if resolution < 0.18 else self.update_box) / 2


DEFAULT = MapConfig()
