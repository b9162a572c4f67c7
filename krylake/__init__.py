"""Spark-first analytics over point sets, sensor fields and the dense kernel systems they induce."""
