"""Part of the lectern package: sinks."""
