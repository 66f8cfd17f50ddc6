"""DataFrame operators: rules and reports, grouped summaries, statistics, ranking,
exact-size sampling, the per-row transform, and the partition-count guard."""
