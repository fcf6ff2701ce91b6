"""DataFrame -> DataFrame operators. Column names are parameters with the
domain names as defaults, so the same operator runs on domain files and on
the driver-table binding."""
