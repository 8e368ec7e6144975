"""Column functions: text, paths, arrays, vectors.  All of them stay on the JVM."""
