"""Plans over records: the derived tables, filters, budgets, order and pages."""
