"""Queries over the tables, each with its SQL: QUERIES and ORACLE of every module."""
