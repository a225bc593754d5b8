"""Product-analytics event processing as Spark DataFrame jobs."""

from eventloom.model import EventQuery, Limits
from eventloom.session import build_session, prepare

__all__ = ["EventQuery", "Limits", "build_session", "prepare"]
