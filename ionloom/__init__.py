"""Ionloom: a Spark-first analytics engine for mass-spectrometry tables and spectra."""
