"""wardline: security-event analytics expressed as Spark DataFrame and streaming jobs."""

from wardline.settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
