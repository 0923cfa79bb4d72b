"""Writers: audit logs, state tables, record logs, metric texts and reports."""
