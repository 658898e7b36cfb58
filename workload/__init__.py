"""The operators as queries over the given tables, each with independent SQL where SQL can say it."""
