"""Distributed recipes that the operators share: positions, running values, neighbours, runs."""

from .ranking import compact, dense_pos
from .scan import islands, neighbour, running, scan_with, segment_scan

__all__ = ["compact", "dense_pos", "islands", "neighbour", "running", "scan_with", "segment_scan"]
