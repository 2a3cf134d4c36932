"""Sub-word tokenisation on Spark: split, encode, decode, train and analyse text columns."""
