"""The SQL front end: dialect profiles, lexer, syntax tree, parser, writer and the tools around them.  No Spark here."""
