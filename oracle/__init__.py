"""Reference answers in DuckDB SQL, formulated apart from the Spark operators."""
