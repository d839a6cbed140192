"""quillfold: a document-collection engine on PySpark DataFrames."""
