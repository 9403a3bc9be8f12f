"""DataFrame -> DataFrame operators (cleaning, profiling, distributions, trends, metrics, models)."""
