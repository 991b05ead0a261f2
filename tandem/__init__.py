"""Active/standby stream state on Spark: folds, gated sinks, handoff audits."""
