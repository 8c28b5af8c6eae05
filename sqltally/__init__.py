"""Text-to-SQL evaluation, reward and rollout analytics as Spark DataFrame jobs."""
