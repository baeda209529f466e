"""A PySpark-native engine for neurophysiology recordings: spike trains, events, intervals, waveforms and signals."""

from .errors import SessionError
from .session import Session, SessionBuilder, diff

__all__ = ["Session", "SessionBuilder", "SessionError", "diff"]
