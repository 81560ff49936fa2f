"""Part of strandlake; see the README."""
