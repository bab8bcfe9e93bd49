"""auditframe: a Spark-native data-audit, cleaning and reconciliation engine."""
