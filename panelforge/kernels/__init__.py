"""Sequential and linear-algebra steps as plain functions of arrays, without Spark."""
