"""Operators for preparing training corpora: packing, archives, classifiers, duplicates, secrets and filters.

Nothing else in the package imports this subpackage.
"""
