"""Column functions: ``Column -> Column``, all evaluated in the JVM unless a name says otherwise."""
