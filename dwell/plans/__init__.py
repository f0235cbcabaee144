"""Named reports and the registered queries."""
