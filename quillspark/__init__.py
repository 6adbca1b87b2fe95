"""quillspark: document-evidence analytics on Spark DataFrames."""
