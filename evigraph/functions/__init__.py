"""Column expressions. Each function takes and returns Columns and stays inside the JVM unless it says otherwise."""
