"""Column expressions: everything here stays inside the JVM and codegen."""
