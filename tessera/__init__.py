"""Panel analytics on PySpark: point-in-time joins, features, labels, splits, portfolios and reports."""
