"""framewright: frame, event, search and document analytics declared on Spark DataFrames."""
