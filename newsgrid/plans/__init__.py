"""Registered queries: operators applied to the tables of a folder, each with its DuckDB SQL."""
