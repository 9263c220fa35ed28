"""Superpixel segmentation and raster analytics as Spark DataFrame operators."""
