"""The measure language: parsing, compilation to columns, and metric views."""
