"""Analytics of semi-structured record feeds on Spark."""

from siftline.operators.feed import FeedFrame
from siftline.sources.reader import read_feed

__all__ = ["FeedFrame", "read_feed"]
