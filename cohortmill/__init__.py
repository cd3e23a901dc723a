"""Eligibility analytics on Spark: narratives to criteria, terminology coding, cohort matching."""
