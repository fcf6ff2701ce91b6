"""Column-expression helpers. Everything here builds JVM-side Catalyst
expressions (no Python UDFs), so it stays inside whole-stage codegen."""
