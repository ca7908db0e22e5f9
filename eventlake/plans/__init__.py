"""Plans: named queries over the given tables (the registry behind __spark_entry__)."""
