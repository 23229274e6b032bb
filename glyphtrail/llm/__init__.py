"""Training-data operators: near-dedup, filtering, decontamination, mixing, sharding.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is there.
"""
