"""Composable Spark DataFrame operators and the analyses built from them."""
