"""Training-data operators: secrets, decontamination, packing, quality, neighbours, extraction, duplicates, licenses, toxicity.

Nothing else in the library imports this subpackage.
"""
