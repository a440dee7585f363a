"""pairgauge: scoring, repairing and comparing structured bilingual text with PySpark."""
