"""Spark jobs for corpora that pair natural-language sentences with first-order-logic formulas."""
