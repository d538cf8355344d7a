"""Thresholds of every stage, passed explicitly; nothing here is changed at run time."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Filters:
    # sequences
    ave: int = 15
    ave_min: int = 2
    ave_M: float = 20
    ave_D: float = 5
    ave_splice: float = 50
    # parameters of runs: L, I, D, M
    ave_params: tuple[float, float, float, float] = (0.5, 1.2, 1.2, 1.2)
    pp_M: float = 10
    pp_D: float = 2
    # sub-runs of compared runs: search ends under this; runs longer than ave_Ls have theirs compared
    stop_D: float = 10
    ave_Ls: int = 3
    # grids
    ave_g: int = 30
    ave_r: int = 10
    # blobs compared over distance: costs of intensity, angle, gradient and size fall by the power of ave_rM; a search goes on above ave_mB
    ave_blob: tuple[float, float, float, float] = (15, 0.5, 2, 1)
    ave_rM: float = 0.7
    ave_mB: float = 10
    # regions of a direction: weak under ave_dir a pixel, spliced above ave_dir_splice in all
    ave_dir: float = 10
    ave_dir_splice: float = 100
    # edges, slices
    ave_I: float = 10
    ave_G: float = 10
    ave_dangle: float = 0.95
    ave_slice_m: float = 10
    ave_slice_d: float = 10
    # graphs
    ave_node: float = 0.3
    ave_node_d: float = 0.3
    # centroids: worth more than ave_cent, stable under a mean difference of ave_cent_d
    ave_cent: float = 0.45
    ave_cent_d: float = 1
    max_dist: float = 20
    decay: float = 0.95

    def scaled(self, r: float) -> Filters:
        """A copy with the thresholds of grid and edge stages scaled by r."""
        return replace(self, **{k: type(getattr(self, k))(getattr(self, k) * r) for k in ("ave_g", "ave_r", "ave_I", "ave_G")})


DEFAULT = Filters()
