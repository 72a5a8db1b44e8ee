"""Curation, featurization, selection, label-noise and experiment analytics as Spark plans."""
