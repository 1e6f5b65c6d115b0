"""Timed screen-media analytics on Spark: readers, timelines, segmentation, alignment."""
