"""Operators for training-data pipelines: packing, fingerprints, language, tokens, dedup, decontamination."""
