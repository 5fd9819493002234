"""Region comparison on Spark: spatial joins, roll-ups, scores, scenarios and publishing."""

from regionscore.config import RegionConfig

__all__ = ["RegionConfig"]
