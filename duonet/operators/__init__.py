"""Relational operators over long tables: (assay, group, sample_id, feature_id, value)."""
