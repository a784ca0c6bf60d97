"""Dataset-scale algorithmic operators, expressed as Spark logical plans."""
