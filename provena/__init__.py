"""provena: evidence-first analytics as plain functions over Spark DataFrames."""
