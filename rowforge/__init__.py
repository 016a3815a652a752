"""rowforge: analytics over tables whose rows carry vectors, signals and parameter settings, on Spark."""
