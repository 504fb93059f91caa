"""Column-level functions; everything here stays on the JVM."""
