"""Column-level helpers: seeded keys, text tokenisers, scorer registry."""

from trajspark.functions.keys import bucket_of, sa_key, seeded_key, seeded_order, seeded_uniform

__all__ = ["bucket_of", "sa_key", "seeded_key", "seeded_order", "seeded_uniform"]
