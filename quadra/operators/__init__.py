"""DataFrame operators: spatial, distance and nearest-neighbour joins, dissolve, layout, statistics."""

from quadra.operators.dissolve import pairwise_dissolve
from quadra.operators.joins import distance_join, join_qr
from quadra.operators.knn import knn_join
from quadra.operators.layout import prune_by_area, write_qr_layout

__all__ = ["distance_join", "join_qr", "knn_join", "pairwise_dissolve", "prune_by_area", "write_qr_layout"]
