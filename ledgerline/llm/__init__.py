"""Training-data operators: joins, tokenisation, scans, classifiers, archives, packing and search.

Nothing outside this subpackage imports it.
"""
