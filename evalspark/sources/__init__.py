"""Reading and writing questions, result tables, statistics and category maps."""
