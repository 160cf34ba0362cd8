"""Training-data operators: cleaning, deduplication, extraction, counting and packing of text.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if it is there.
"""
