"""Event-correlation and wire-format analytics expressed as Spark plans."""
