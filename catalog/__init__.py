"""The registered queries: every operator on whole test tables, next to the SQL it must agree with."""
