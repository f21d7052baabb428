"""annolith: annotation datasets (boxes, keypoints, frames, pages) as Spark DataFrames."""

__version__ = "0.1.0"
