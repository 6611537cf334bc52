"""The registered queries, and their equivalents in DuckDB SQL."""
