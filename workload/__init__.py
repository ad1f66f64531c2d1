"""The registered workload: views over the given tables, queries, oracle SQL."""
