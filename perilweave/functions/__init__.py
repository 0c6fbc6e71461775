"""Column-level building blocks: statistics, copulas, rules, grid conversion."""
