"""Column expressions that Spark lacks, built from JVM-side functions only."""
