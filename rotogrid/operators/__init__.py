"""Relational operators: grids, scores, peaks, masks, atoms, rotations, ingestion."""
