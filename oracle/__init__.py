"""Reference answers in DuckDB SQL, written on their own and not from the Spark code."""
