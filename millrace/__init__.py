"""millrace: materialized views kept up to date on Spark, and a toolbox for text corpora."""
