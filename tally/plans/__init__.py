"""Named reports (``reports.REPORTS``) and their reference SQL (``oracle.oracle_sql``)."""
