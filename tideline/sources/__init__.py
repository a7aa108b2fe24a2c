"""Readers of sample, label, line, raster, log and detection files; writers of results."""
