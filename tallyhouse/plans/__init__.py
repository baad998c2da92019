"""The jobs: which operators run, and in which order."""
