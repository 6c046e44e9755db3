"""netloom: packet and event analytics declared as Spark DataFrame plans."""

from netloom.session import get_session

__all__ = ["get_session"]
