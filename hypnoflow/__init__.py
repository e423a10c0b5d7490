"""Sleep-signal analytics on Spark: recordings, filters, resampling, epochs and derivations as DataFrame jobs."""

__version__ = "0.1.0"
