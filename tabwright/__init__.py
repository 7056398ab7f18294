"""tabwright: table wrangling and data quality on Spark DataFrames."""
