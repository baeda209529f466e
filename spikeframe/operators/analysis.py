"""The usual look at one unit around one event, and the names that the analyses go by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import Session
from .spikes import in_range, psth, raster


@dataclass(frozen=True)
class Analysis:
    psth: DataFrame
    raster: DataFrame
    spikes: DataFrame
    events: DataFrame


def analyse(s: Session, neuron: str, event: str, start: float = -0.5, end: float = 1.0, bin_width: float = 0.01, spike_range: tuple[float, float] | None = None) -> Analysis:
    """PSTH, raster and times of a neuron around an event; `spike_range` restricts the spikes only."""
    spikes, events = s.payload(neuron, "neuron"), s.payload(event, "event")
    if spike_range is not None:
        spikes = in_range(spikes, *spike_range)
    return Analysis(psth(spikes, events, start, end, bin_width), raster(spikes, events, start, end), spikes.select("idx", "t"), events.select("idx", "t"))
