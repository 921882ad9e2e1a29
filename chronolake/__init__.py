"""chronolake: change history and time travel over tables, as PySpark DataFrame operations."""
