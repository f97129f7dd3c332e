"""tessera: text-corpus analytics and boolean search on Spark DataFrames."""
