"""Tessella: question-answering and corpus analytics as Spark DataFrame operators."""
