"""valuefit: Spark jobs that estimate answer values from partial answers and evaluate such estimates."""
