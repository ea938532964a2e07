"""Training-data operators: scoring, mixing, decontamination, search, privacy, de-duplication, export.

Nothing outside this subpackage imports it; removing the folder removes the feature.
"""
