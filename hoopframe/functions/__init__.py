"""Column-expression helpers; everything here compiles to built-in Spark expressions."""
