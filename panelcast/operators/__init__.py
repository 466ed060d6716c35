"""Panel operators: DataFrame in, DataFrame out."""
