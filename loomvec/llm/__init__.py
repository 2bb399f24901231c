"""Operators for preparing training data. Nothing else in loomvec imports this."""
