"""Sources and sinks: CSV loaders, the driver-table adapter, table writers and small reports."""
