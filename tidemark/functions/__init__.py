"""Column builders. Everything here stays inside the JVM unless its docstring says otherwise."""
