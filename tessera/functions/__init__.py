"""Column expressions: geometry, cells and fingerprints."""
