"""Labelled prompt corpora on Spark: prepare, split, augment, decontaminate, train, score and report."""
