"""Training-data operators: URL filters, licences, decontamination, privacy, formatting, secrets,
near duplicates, language identification, quality rules and source mixing.

Nothing outside this subpackage imports it.
"""
