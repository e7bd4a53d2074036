"""seqloom: sequence-search analytics and corpus preparation on Spark."""
