"""Early-warning panel analytics as composable PySpark DataFrame operators."""
