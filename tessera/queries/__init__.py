"""The registered queries by subject, each with the same in DuckDB SQL where SQL can express it."""
