"""Training-data operators: capping, sampling, splitting, encoding, mixing, repetition.

Nothing outside this subpackage imports it.
"""
