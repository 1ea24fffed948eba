"""Whole plans: the query catalogue and the corpus graph facade."""
