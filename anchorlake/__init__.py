"""Link-quality analytics as composable PySpark DataFrame transformations."""
