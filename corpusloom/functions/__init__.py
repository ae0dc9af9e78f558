"""Column functions: native Spark expressions unless a name says otherwise."""
