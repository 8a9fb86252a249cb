"""The registered queries and their plain-SQL counterparts."""
