"""Molecules from SMILES: descriptors, patterns, filters, fingerprints, shapes and common substructures."""
