"""Pure Column functions: ids, ordinal domains, parsing."""
