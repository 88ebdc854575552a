"""premia: penalised generalised linear and additive models as Spark-native operators."""
