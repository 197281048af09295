"""Pixel relations, trainable segmentation and training-data operators on Spark."""
