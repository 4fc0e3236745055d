"""Source-grounded information extraction over DataFrames of documents."""
