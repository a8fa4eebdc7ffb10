"""Every operator as a named query over the driver's tables, with SQL to check it by."""
