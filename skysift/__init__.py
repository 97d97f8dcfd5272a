"""Spark jobs for auditing signal catalogs, waveforms and spectra."""
