"""Part of the lectern package: streaming."""
