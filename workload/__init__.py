"""The registered queries: each operator over the whole test tables, with its SQL twin."""
