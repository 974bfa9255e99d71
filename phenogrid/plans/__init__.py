"""Plans: cohorts, matrices, hold-outs, runs, merging."""
