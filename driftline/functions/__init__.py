"""Column expressions; everything here runs JVM-side unless it says otherwise."""
