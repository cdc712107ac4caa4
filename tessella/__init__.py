"""Tessella: rights-contract analytics and corpus preparation as composable Spark operators."""
