"""Analytics over time-based media on Spark: streams, packets, frames, cues and meshes as DataFrames."""
