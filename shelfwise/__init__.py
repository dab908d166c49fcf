"""Weekly point-of-sale demand-transfer analytics as PySpark DataFrame operators."""

from shelfwise.config import RetailConfig

__all__ = ["RetailConfig"]
