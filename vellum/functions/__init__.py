"""Column functions: each takes and returns columns, and runs in the JVM unless its module says otherwise."""
