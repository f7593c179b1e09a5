"""Options of a dataset build, with the scalars that are derived from the number of points."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BuildOptions:
    """max_points_per_chunk 0: a twentieth of the points, ten million at most. Unknown samplers mean Poisson-disk."""

    max_points_per_chunk: int = 0
    min_grid_size: int = 0
    first_chunk_size: int = 4096
    step_size: int = 4
    sampling: str = "poisson"

    def __post_init__(self):
        if self.min_grid_size and self.min_grid_size & (self.min_grid_size - 1):
            raise ValueError("min_grid_size must be a power of two")

    def grid_size(self, points: int) -> int:
        return max(self.min_grid_size, 128 if points < 100_000_000 else 256 if points < 500_000_000 else 512)

    def grid_level(self, points: int) -> int:
        return self.grid_size(points).bit_length() - 1

    def chunk_cap(self, points: int) -> int:
        return self.max_points_per_chunk or min(points // 20, 10_000_000)
