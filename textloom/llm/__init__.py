"""Training-data operators: sharding, licences, quality, search, tokens, mixing, dedup, toxicity, LM scores.

Nothing else in the library imports this subpackage.
"""
