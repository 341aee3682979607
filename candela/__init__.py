"""candela: market-bar analytics and corpus operators on Spark DataFrames."""
