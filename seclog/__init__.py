"""Security-log analytics on PySpark: parse, enrich, model, score, detect."""
