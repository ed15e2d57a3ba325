"""Label-compliance analytics and text-corpus preparation on PySpark."""
