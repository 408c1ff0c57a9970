"""Column functions over text, labels and vectors; all stay inside the JVM."""
