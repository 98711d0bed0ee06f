"""fitgrain: fit-on-train / apply-anywhere table operators, model evaluation
queries and document retrieval, written as Spark DataFrame plans."""

__version__ = "0.1.0"
