"""Training-data operators: tokenizing, near-duplicates, classifiers, search and decontamination.

Nothing else in the package imports this one; it can be removed as a whole.
"""
